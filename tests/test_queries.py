"""Every query of the engine against its oracle on the smallest tables, and what the expressions do at their edges."""

import math
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.evals.suite import THRESHOLDS
from engram.functions import text as T
from engram.functions.json_text import model_object, redact
from engram.functions.vector import embed_text, embedder, l2, top_k
from engram.operators import consolidation as C
from engram.operators import extraction as E
from engram.operators.asof import as_of
from engram.operators.history import closure, closure_by_doubling, descendants, neighbourhood
from engram.operators.memory import Memory, candidates, police
from engram.operators.retrieval import first, fuse, pack, ranks
from engram.plans import registry
from engram.plans.temporal import ORPHANS, SEED_QUESTION, status_label
from engram.sources import views
from engram.sources.views import SPARK_TABLES

DATA = "/root/testdata/sf0.001"
NEEDS_DATA = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in SPARK_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(x):
    return "~" if x is None else ("nan" if math.isnan(x) else repr(x)) if isinstance(x, float) else str(x)


@NEEDS_DATA
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if name in registry.ORACLE_SQL:
        found = duck.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in found.fetchall())
        assert got == want
    else:
        assert name in {"hash_embed", "memory_fold", "evaluation_suite", "seed_entities", "vector_ivf"} and got


@NEEDS_DATA
def test_seeds_equal_brute_force(spark):
    entities = views.table(spark, DATA, "v_entities").collect()
    words, asked = {w.casefold() for w in re.findall(r"\w{2,}", SEED_QUESTION)}, embed_text(SEED_QUESTION, 256, {})
    near = lambda e: round(float(embed_text(e.name, 256, {}).astype(np.float32).astype(float) @ asked), 6)
    got = registry.QUERIES["seed_entities"](spark, DATA).collect()
    for kind in {e.kind for e in entities}:
        own = {e.entity_id: e for e in entities if e.kind == kind}
        rows = sorted((r for r in got if r.entity_id in own), key=lambda r: r.place)
        ranked = sorted((e.name.lower() not in words, -near(e) if e.name.lower() not in words else 0, e.entity_id) for e in own.values())[:5]
        assert [r.name.lower() in words for r in rows] == [not miss for miss, *_ in ranked]
        assert [r.similarity for r in rows] == pytest.approx([near(own[i]) for *_, i in ranked], abs=2e-6)
    assert {r.name for r in got if r.place == 1} >= {"ASIA", "NATION_1"}


def test_orphans_are_entities_without_any_edge(spark):
    spark.createDataFrame([(7, "a"), (8, "b"), (9, "c"), (14, "d")], "entity_id long, name string").createOrReplaceTempView("v_entities")
    spark.createDataFrame([(7, 8), (14, 7)], "src long, dst long").createOrReplaceTempView("v_edges")
    got = spark.sql(ORPHANS).collect()
    for name in ("v_entities", "v_edges"):
        spark.catalog.dropTempView(name)
    assert [tuple(r) for r in got] == [(9, "c")]


def test_every_status_has_a_label_and_others_stay(spark):
    rows = [("active",), ("superseded",), ("retracted",), ("erased",), ("unknown",), (None,)]
    got = spark.createDataFrame(rows, "status string").select(status_label(F.col("status")).alias("label")).collect()
    assert [r.label for r in got] == ["aktiv", "abgelöst", "zurückgezogen", "gelöscht", "unknown", None]


@NEEDS_DATA
@pytest.mark.parametrize("name", ["orphan_entities", "turns_to_redact", "export_history", "vector_topk_per_group", "erase_facts_projection"])
def test_no_nested_loops(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)


@NEEDS_DATA
def test_filters_and_columns_reach_the_scan(spark):
    plan = spark.read.parquet(f"{DATA}/events.parquet").filter("event_id > 5").select("user_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,5)" in plan and "value" not in plan.split("ReadSchema")[1]


# -- expressions at their edges ---------------------------------------------------------------------------------------


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_as_of_follows_its_four_cases(spark):
    rows = [("k", "superseded", "2026-01-10", "2026-06-14", "2026-01-10", "2026-06-14"), ("l", "active", "2026-06-14", None, "2026-06-14", None), ("r", "retracted", "2026-01-01", "2026-07-01", "2026-01-01", "2026-07-01"), ("e", "erased", "2026-01-01", None, "2026-01-01", None)]
    df = spark.createDataFrame(rows, "id string, status string, valid_from string, valid_to string, recorded_at string, invalidated_at string")
    df = df.select("id", "status", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("valid_from", "valid_to", "recorded_at", "invalidated_at")])
    seen = lambda **at: {r.id for r in df.filter(as_of(**at)).collect()}
    assert seen() == {"l"} and seen(tx="2026-03-01") == {"k", "r"} and seen(valid="2026-03-01") == {"k"} and seen(valid="2026-09-01") == {"l"}
    assert seen(tx="2026-02-01", valid="2026-07-02") == set() and seen(tx="2026-06-14") == {"l", "r"} and seen(valid="2026-06-14") == {"l"}


def test_closure_stops_on_cycles_and_counts_shared_descendants_once(spark):
    dag = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (1, 4), (9, None)], "fact_id long, parent_id long")
    got = {(r.root, r.fact_id) for r in closure(dag, spark.createDataFrame([(1,), (9,)], "root long")).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (1, 4), (9, 9)}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "fact_id long, parent_id long")
    assert {(r.root, r.fact_id) for r in closure_by_doubling(chain, chain).collect()} == {(a, b) for a in range(40) for b in range(a, 40)}
    circle = {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4)} | {(9, 9)}
    assert {(r.root, r.fact_id) for r in closure_by_doubling(dag, dag).collect()} == circle
    two = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (7, 2)], "fact_id long, parent_id long")
    rows = closure_by_doubling(two, two.select("fact_id")).collect()
    assert sorted((r.root, r.fact_id) for r in rows) == [(1, 1), (1, 2), (1, 7), (2, 1), (2, 2), (2, 7), (3, 3), (7, 7)]
    assert [sorted(r.fact_id for r in descendants(d, spark.createDataFrame(ids, "root long")).collect()) for d, ids in ((dag, [(2,), (2,), (9,)]), (two, [(7,)]), (dag.limit(0), [(5,)]))] == [[1, 2, 3, 4, 9], [7], [5]]
    again = closure(chain, closure(chain, spark.createDataFrame([(30,)], "root long")).select(F.col("fact_id").alias("root")))
    assert {r.fact_id for r in again.collect()} == set(range(30, 40))


def test_neighbourhood_reaches_one_edge_further_than_its_hops(spark):
    path = spark.createDataFrame([(i, i + 1, 100 + i) for i in range(6)], "src long, dst long, fact_id long")
    got = {r.fact_id: r.hop for r in neighbourhood(path, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {100: 1, 101: 2, 102: 3}


def test_fusion_ties_limits_and_permutations(spark):
    hits = [("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 2)]
    rows = [(0, s, f, float(n)) for n, (s, f) in enumerate(hits)] + [(1, "a", 7, 0.0), (1, "a", 3, 1.0), (1, "b", 3, 0.0), (1, "b", 7, 1.0)]
    df = spark.createDataFrame(rows, "query_id long, source string, fact_id long, score double")
    visible = spark.createDataFrame([(i,) for i in (2, 3, 7)], "fact_id long")
    for frame in (df, df.orderBy(F.desc("fact_id")).repartition(3)):
        best = first(fuse(ranks(frame, F.col("score"))), visible, 2).orderBy("query_id", "place").collect()
        assert [(r.query_id, r.fact_id) for r in best] == [(0, 2), (0, 3), (1, 3), (1, 7)]
        assert best[0].sources == {"a": 2, "b": 1, "c": 1}


def test_packing_skips_what_does_not_fit(spark):
    rows = [(0, k, k, "x" * n) for k, n in enumerate((8, 400, 8, 8), 1)]
    got = pack(spark.createDataFrame(rows, "query_id long, place int, fact_id long, line string"), budget=9, header="head").first()
    assert (got.included, got.dropped, got.tokens_used) == ([1, 3, 4], [2], 7) and got.text == "head\n" + "\n".join(["x" * 8] * 3)
    none = pack(spark.createDataFrame(rows[1:2], "query_id long, place int, fact_id long, line string"), budget=3, header="head").first()
    assert (none.text, none.included, none.tokens_used) == ("", [], 1)


def test_policy_column_equals_the_row_function(spark):
    cases = [(op, t, c / 100) for op in C.OPS for t in ([], [1], [2, 1], [9]) for c in (10, 34, 35, 54, 55, 74, 75, 90)]
    df = spark.createDataFrame(cases, "op string, targets array<bigint>, c double").withColumn("seen", F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))
    rows = df.withColumn("p", C.policy(F.col("op"), F.col("targets"), F.col("c"), F.col("seen"))).collect()
    assert len(rows) == len(cases)
    for r in rows:
        assert (r.p.op, r.p.targets) == police(r.op, r.targets, r.c, {1, 2})
        assert r.p.proposed == (r.op if r.p.op != r.op else None)


def test_text_functions(spark):
    got = one(spark, T.or_query(F.lit("Wo wohnt er? Wo")), T.strip_punctuation(F.lit(" ab?! . ")), T.token_estimate(F.lit("")), T.token_estimate(F.lit("12345")), T.sentences(F.lit("A b.  C?\nd\n\n")), T.content_ref(F.lit(None).cast("string")))
    assert got[:4] == ("wo or wohnt or er", "ab", 1, 2) and got[4] == ["A b.", "C?", "d"] and got[5] == "e3b0c44298fc"
    df = spark.createDataFrame([("ÜBER 100% Straße a_b", None), (None, None)], "t string, u string")
    seen = df.select(T.normalise("t"), T.like_any(F.col("t"), ["100%"]), T.like_any(F.col("t"), ["1_0"]), T.matches(F.lit("re:^über \\d"), F.col("t")), T.matches(F.lit("A_B"), F.col("t"))).collect()
    assert tuple(seen[0]) == ("uber 100% strasse a_b", True, False, True, True) and seen[1][0] is None
    kinds = spark.createDataFrame([("Hi you.",), ("Wie?",), ("maybe so",), ("Hiér",)], "s string").select(T.sentence_kind(F.col("s"))).collect()
    assert [k[0] for k in kinds] == ["greeting", "question", "hedged", "plain"]


def test_json_functions(spark):
    df = spark.createDataFrame([('{"a":[{"b":"geheim","c":3}],"d":null,"e":{"f":true}}',), ("kein JSON",), (None,), ("[" * 40 + "]" * 40,)], "j string")
    got = [r[0] for r in df.select(redact("j")).collect()]
    assert got[0] == '{"a": [{"b": null, "c": null}], "d": null, "e": {"f": null}}' and got[1:3] == [None, None] and "null" in got[3]
    said = spark.createDataFrame([("So: ```json\n{\"op\": 1}\n``` {x}",), ("vor {\"op\": {\"a\": 2}} nach",), ("[1]",), ("",)], "t string").select(model_object(F.col("t"))).collect()
    assert [r[0] for r in said] == ['{"op": 1}', '{"op": {"a": 2}}', None, None]


def test_vectors(spark):
    a, b, c = (embed_text(x, 256, {}) for x in ("Wohnt in Köln", "wohne in koln", "Mag Kaffee"))
    assert a @ b > 0.5 > a @ c and abs(a @ a - 1) < 1e-9 and embed_text("", 8, {})[0] == 1
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(50)] + [(99, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert one(spark, l2(F.array(F.lit(3.0), F.lit(4.0))), l2(F.array(F.lit(0.0))))[0] == [0.6, 0.8]
    small = {(r.query_id, r.vec_id, r.place) for r in top_k(df.filter("vec_id < 7"), df, 3, block=2).collect()}
    whole = {(r.query_id, r.vec_id, r.place) for r in top_k(df.filter("vec_id < 7"), df, 3).collect()}
    assert small == whole and len(whole) == 21
    assert top_k(df.limit(0), df, 3).count() == 0
    assert df.select(F.size(embedder(32)(F.lit("x")))).first()[0] == 32


def test_extraction_columns_agree_with_the_row_function(spark):
    said = ["Ich wohne in Köln.", "Ich bin nach Leipzig gezogen. Ich mag Tee. ICH MAG TEE!", "Vergiss, was ich über meinen Arbeitgeber gesagt habe.", "Ich habe einen Hund; Danke.", "Ich glaube, ich mag Brot", "I'm Tom. Is it?", "Ich heisse Öl", "Ich bin seit Mai Vater", "", "Das."]
    turns = spark.createDataFrame([(k, "user", t, "2026-05-05 00:00:00") for k, t in enumerate(said)], "turn_id long, role string, content string, at string").selectExpr("turn_id", "role", "content", "cast(at as timestamp_ntz) occurred_at")
    rows = E.extract(turns).filter("reason IS NULL").orderBy("turn_id", "place").collect()
    want = [(k, c["content"], c["op_hint"], c["confidence"]) for k, t in enumerate(said) for c in candidates({"subject_id": "s", "role": "user", "content": t, "occurred_at": "2026-05-05T00:00:00"})]
    assert [(r.turn_id, r.content, r.op_hint, r.confidence) for r in rows] == want and len(want) >= 7
    assert E.extract(turns.limit(0)).count() == 0
    assert one(spark, E.revoked_predicates(F.lit("meine arbeit und mein name")))[0] == ["arbeitet_bei", "heisst"]


def test_bounds_are_those_of_the_suite():
    assert THRESHOLDS == {"update_recall": 0.90, "stale": 0.10, "false_retraction": 0.05, "erasure": 1.0} and Memory("s").facts == []


def test_vectors_and_folded_texts_leave_a_task_in_small_pieces(spark):
    import pandas as pd

    from engram.functions import vector

    texts = pd.Series([f"Wort {k} Ärger" for k in range(1_000)] + [None])
    pieces = list(embedder(16).func(iter([texts])))
    assert max(map(len, pieces)) <= vector.AT_ONCE and all((a == embed_text(t, 16, {}).astype(np.float32)).all() for a, t in zip(pd.concat(pieces), texts, strict=True))
    folded = list(T.normalise.func(iter([texts])))
    assert max(map(len, folded)) <= T.AT_ONCE and pd.concat(folded).tolist()[:1_000] == [T.fold(t) for t in texts[:1_000]]
    rows = spark.range(0, 3_000, 1, 1).select("id", F.concat(F.lit("Wort "), F.col("id").cast("string")).alias("text")).select("id", "text", embedder(16)("text").alias("v"), T.normalise("text").alias("n"))
    assert all(r.n == f"wort {r.id}" and r.v == embed_text(r.text, 16, {}).astype(np.float32).tolist() for r in rows.collect())
