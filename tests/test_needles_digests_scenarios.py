"""Needles against a plain filter, digests against a full outer join, scenario files as a data source."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from engram.evals import suite
from engram.operators.digests import DigestedTable, differences
from engram.operators.needles import holding
from engram.sources import scenarios


@pytest.mark.parametrize(("group", "part"), [(3, 7), (50_000, 100_000)])
def test_needles_equal_a_plain_filter(spark, group, part):
    r = random.Random(group)
    draw = lambda n: "".join(r.choice("aAbÄ%_\\ ß") for _ in range(n))
    texts = [(k, draw(r.randint(0, 30))) for k in range(80)] + [(3, "aab"), (900, None), (901, "")]
    needles = [draw(r.randint(0, 3)) for _ in range(40)] + ["", "", None, "Aa", "aA", "%", "_", "\\"]
    df, wanted = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in needles], "needle string")
    got = Counter(map(tuple, holding(df, wanted, group, part).collect()))
    lower = {x: y for x, y in spark.createDataFrame([(x,) for x in {t for _, t in texts if t is not None} | {n for n in needles if n is not None}], "x string").select("x", F.lower("x")).collect()}
    assert got == Counter((i, n) for i, t in texts for n in set(needles) if t is not None and n is not None and lower[n] in lower[t])
    assert holding(df, wanted.limit(0)).collect() == holding(df.limit(0), wanted).collect() == []


def test_ten_thousand_needles_in_one_pass(spark):
    texts = spark.range(2_000).select("id", F.concat(F.lit("Kunde "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" wohnt hier")).alias("text"))
    needles = spark.range(10_000).select(F.concat(F.lit("KUNDE "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("needle"))
    found = holding(texts, needles)
    assert found.count() == 2_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("MapInPandas") == 1


def tables(spark, tmp_path, *sides):
    for n, rows in enumerate(sides):
        table = DigestedTable(spark, str(tmp_path / str(n)), ranges=8)
        table.build(spark.createDataFrame(rows, "subject_id long, said string, bucket string"))
        yield table


@pytest.mark.parametrize("changes", [0, 3, 60])
def test_differences_equal_a_full_outer_join(spark, tmp_path, changes):
    r = random.Random(changes)
    one = [(r.randint(0, 40), f"s{r.randint(0, 30)}", r.choice(["a", "b", None])) for _ in range(300)] + [(None, "x", "a"), (1, None, "a")]
    other = list(one)
    for _ in range(changes):
        other[r.randrange(300)] = (r.randint(0, 45), f"s{r.randint(0, 35)}", r.choice(["a", "c"]))
    a, b = tables(spark, tmp_path, one, other)
    said = lambda rows: {(s, t) for s, t, _ in rows if s is not None and t is not None}
    want = {(*x, "only_original") for x in said(one) - said(other)} | {(*x, "only_replay") for x in said(other) - said(one)}
    got = differences(a, b)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)


def test_only_the_folders_of_differing_ranges_are_read(spark, tmp_path):
    one = [(k, f"s{k}", "a") for k in range(400)]
    a, b = tables(spark, tmp_path, one, [*one, (7, "new", "b")])
    got = differences(a, b)
    assert [tuple(x) for x in got.collect()] == [(7, "new", "only_replay")]
    place = a.rows().filter("subject_id = 7").first()["range"]
    assert f"[{place}]" in got._jdf.queryExecution().optimizedPlan().toString() or f"= {place})" in got._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        differences(a, DigestedTable(spark, "x", ranges=9))
    c, d = tables(spark, tmp_path / "empty", [], [])
    assert differences(c, d).collect() == [] and differences(a, c).count() == 400


YAML = """
id: {name}
pattern: Kette
turns:
  - {{at: 2024-01-02, text: "Ich wohne in Ulm."}}
  - {{at: 2024-02-02, text: "Ich ziehe nach Köln um."}}
checkpoints:
  - {{after: 2, query: "Wo?", expect_present: [Köln], expect_absent: [Ulm]}}
erasure: {{after: 2, facts_matching: Ulm, residue: [Ulm]}}
preconditions: [Köln]
"""


def test_scenario_files_as_a_data_source(spark, tmp_path):
    scenarios.register(spark)
    read = lambda path: spark.read.format("engram_scenarios").load(str(path))
    folder = tmp_path / "suite"
    folder.mkdir()
    for name in ("eins", "zwei", "drei"):
        (folder / f"{name}.yaml").write_text(YAML.format(name=name), encoding="utf-8")
    (folder / "notes.txt").write_text("no scenario")
    df = read(folder)
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 3
    assert Counter((r.scenario, r.kind) for r in rows) == Counter({(n, k): c for n in ("eins", "zwei", "drei") for k, c in (("turn", 2), ("checkpoint", 1), ("erasure", 1), ("precondition", 1))})
    assert {r.value for r in rows if r.kind == "turn" and r.after == 2} == {'["2024-02-02", "Ich ziehe nach Köln um."]'}
    assert read(f"file://{folder}").count() == len(rows)
    assert {s["id"] for s in suite.load(folder)} == {r.scenario for r in rows}
    (tmp_path / "none").mkdir()
    assert read(tmp_path / "none").collect() == []
    for name, text in (("broken", "a: [1"), ("list", "- 1"), ("short", "id: x\nturns: [{text: y}]")):
        (folder / f"{name}.yaml").write_text(text)
        with pytest.raises(Exception, match=f"{name}.yaml"):
            read(folder).collect()
        (folder / f"{name}.yaml").unlink()


def test_needles_beyond_one_group_send_no_text_to_every_group(spark):
    texts = spark.range(3_000).select("id", F.concat(F.lit("Kunde#"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" und Kunde#000001, Ulm")).alias("text"))
    needles = spark.range(10_000).select(F.concat(F.lit("KUNDE#"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("needle")).union(spark.createDataFrame([("ulm",), ("",)], "needle string"))
    found = holding(texts, needles, group_needles=100)  # a hundred groups of this size
    got = Counter(r.needle for r in found.collect())
    assert got == Counter({f"KUNDE#{k:06d}": 1 for k in range(3_000)}) + Counter({"KUNDE#000001": 2_999, "ulm": 3_000, "": 3_000})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
