"""Steps as VARIANT, redaction that keeps the shape, extraction as a table function: each against a plain version."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from engram.functions.json_text import MAX_DEPTH, named_ids, redact
from engram.operators import extraction as E
from engram.operators.extraction_udtf import extract_table, register
from engram.plans import decisions
from engram.sources import views

DATA = "/root/testdata/sf0.001"
NEEDS_DATA = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def blank(value, depth=0):
    if depth >= MAX_DEPTH and isinstance(value, (dict, list)):
        return None
    if isinstance(value, dict):
        return {k: blank(v, depth + 1) for k, v in value.items()}
    return [blank(v, depth + 1) for v in value] if isinstance(value, list) else None


def made(r, depth=0):
    kind = r.randint(0, 9 if depth < 5 else 6)
    if kind > 7:
        return {r.choice(["id", "fact_id", 'k"q', "ä:ö", "{x", "", "included", "a\\b"]) + r.choice(["", "2"]): made(r, depth + 1) for _ in range(r.randint(0, 4))}
    if kind == 7:
        return [made(r, depth + 1) for _ in range(r.randint(0, 4))]
    return r.choice([None, True, -3, 17, 2.5e-7, 12345678901, "", 'quote " and \\ and \n', "[1, {\"id\": 5}]", "x: y", "ünï", "null"])


def test_redaction_equals_a_plain_walk(spark):
    r = random.Random(1)
    values = [made(r) for _ in range(200)] + [{"a": 1}, [], {}, 5, "text"]
    nest = lambda n, x: nest(n - 1, {"d": x} if n % 2 else [x, 1]) if n else x
    values += [nest(n, "deep") for n in (30, 31, 32, 33, 40)] + [[{} for _ in range(50)]]
    rows = [(k, json.dumps(v, ensure_ascii=bool(k % 2), indent=k % 3 or None)) for k, v in enumerate(values)]
    bad = [(1000, None), (1001, "{broken"), (1002, ""), (1003, '{"a": 1, "a": "twice"}'), (1004, '{"a": 1} rest'), (1005, "1, 2"), (1006, "1] 2"), (1007, '1, "y": 2'), (1008, "1} 2"), (1009, " ")]
    df = spark.createDataFrame(rows + bad, "step_id int, input string")
    out = df.select("step_id", redact("input").alias("out"))
    got = {x.step_id: x.out for x in out.collect()}
    assert [json.loads(got[k]) for k, _ in rows] == [blank(v) for v in values]
    assert all(got[k] is None for k, _ in bad)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    long = spark.createDataFrame([(json.dumps({"k" * 50_000: "v\\\"" * 200_000}),)], "input string").select(redact("input")).first()[0]
    assert long == '{"' + "k" * 50_000 + '": null}'


def test_ids_anywhere_equal_a_plain_walk(spark):
    r = random.Random(2)
    values = [made(r) for _ in range(150)] + [{"included": [1, "2", 3.5, [4], {"id": 9}], "fused": [{"fact_id": 7}, {"fact_id": None}], "id": True}]

    def walk(value, name, depth, out):
        if depth > 4:
            return
        for k, v in value.items() if isinstance(value, dict) else ((name, v) for v in value) if isinstance(value, list) else ():
            if k in ("included", "fact_id", "id") and type(v) is int:
                out.add(v)
            walk(v, k, depth + 1, out)

    want = set()
    for k, v in enumerate(values):
        walk(v, None, 1, ids := set())
        want |= {(k, i) for i in ids}
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(900, None), (901, "no")]
    found = named_ids(spark.createDataFrame(rows, "step_id int, output string"), "output", ("included", "fact_id", "id"))
    assert {tuple(x) for x in found.collect()} == want and found.count() == len(want)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


SAID = [
    "Ich wohne jetzt in Köln. Ich bin gerade in Rom!", "I am currently on leave. I'm tired.", "Vielleicht mag ich Tee.\nIch mag Tee. ICH MAG TEE!", "Vergiss meinen Job. Forget my work", "Wohnst du in Ulm? Hallo Ich heiße Jo.",
    "Ich liebe es. Ich habe einen Hund; Ich trinke keinen Kaffee", "seit 2019: Ich arbeite bei ACME", "Ich wohne seit März in Bonn.", "", None, "Ich bin " + "x" * 130,
]


def plain_and_table(spark, turns):
    columns = ("turn_id", "content", "op_hint", "predicate", "object", "object_kind", "confidence", "temporary")
    plain = E.extract(turns).filter("reason IS NULL").select(*columns)
    return sorted(map(str, plain.collect())), sorted(map(str, extract_table(turns).select(*columns).collect())), columns


def test_table_function_equals_the_column_version(spark):
    rows = [(k, r, s, "2026-03-05 10:00:00") for k, (r, s) in enumerate((r, s) for s in SAID for r in ("user", "assistant"))]
    turns = spark.createDataFrame(rows, "turn_id long, role string, content string, occurred_at string").withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))
    plain, table, columns = plain_and_table(spark, turns)
    assert plain == table and len(table) == 8
    assert {x.object for x in extract_table(turns).filter("temporary").collect()} == {"Rom", "leave"}
    register(spark, "candidates_of")
    lateral = spark.sql("SELECT t.turn_id, c.content FROM {t} t, LATERAL candidates_of(t.turn_id, t.role, t.content, date_format(t.occurred_at, \"yyyy-MM-dd'T'HH:mm:ss\")) c", t=turns)
    assert sorted(map(tuple, lateral.collect())) == sorted((x.turn_id, x.content) for x in extract_table(turns).collect())
    assert extract_table(turns.limit(0)).collect() == []


@NEEDS_DATA
def test_table_function_equals_the_column_version_on_all_turns(spark):
    said = views.sql(spark, DATA, decisions._SAID).select("turn_id", "role", "content", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"))
    turns = said.union(views.table(spark, DATA, "v_turns").select("turn_id", "role", "content", "occurred_at"))
    plain, table, _ = plain_and_table(spark, turns)
    assert plain == table and table


def test_named_ids_read_a_text_once_and_the_preview_reads_steps_once(spark):
    from engram.functions.json_text import each_named_id
    from engram.plans import governance

    rows = [(1, 10, '{"included": [5, 6], "fused": [{"fact_id": 5}], "other": {"id": 7, "x": {"id": {"y": 8}}}}'), (2, 20, "no JSON"), (3, 30, "[]"), (4, None, '{"id": 9}')]
    steps = spark.createDataFrame(rows, "step_id int, trace_id int, output string")
    keyed = steps.selectExpr("struct(step_id, trace_id) AS step", "output")
    found = each_named_id(keyed, "output", governance.NAMES, "step")
    assert sorted((x.step.step_id, x.id) for x in found.collect()) == [(1, 5), (1, 5), (1, 6), (1, 7), (4, 9)]
    assert found._jdf.queryExecution().executedPlan().toString().lower().count("parse_json") <= 2  # the value and its null check


def test_rows_of_a_task_stay_bounded_whatever_their_bytes(spark, monkeypatch):
    from engram import session
    from engram.sources import views

    monkeypatch.setattr(session, "TASK_ROWS", 50)
    n = session.tasks_for(spark, spark.read.parquet("/root/testdata/sf0.001/events.parquet").count())
    assert n > 10
    for name in ("v_derivations", "v_lineage"):
        assert views.by_slot(spark, "/root/testdata/sf0.001", name).rdd.getNumPartitions() % n == 0
