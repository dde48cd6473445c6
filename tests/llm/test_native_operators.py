"""Operators of built-in functions: chat formatting, mixing, exact dedup, fingerprints."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from engram.llm import chat_format, exact_dedup, fingerprints, mixing

DATA = "/root/testdata/sf0.001"
NEEDS_DATA = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0, source="src0"):
    return spark.createDataFrame([(start + k, t, "en", source, len(t or "")) for k, t in enumerate(texts)], DOCS)


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


# -- exact dedup ------------------------------------------------------------------------------------------------------


def dedup_brute(rows):
    classes = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        classes[norm(t)].append(i)
    keep = {n: min((i for i in ids if i is not None), default=None) for n, ids in classes.items()}
    return sorted(((i, keep[norm(t)], len(classes[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)


TEXTS = ["a b", "a  b", "a\t\nb", "a b", None, "", " ", "x" * 300_000, "x" * 300_000, "é", "é", "a b"]


@pytest.mark.parametrize("hash128", [exact_dedup.content_hash, lambda t: F.lit("same"), lambda t: F.length(t).cast("string")])
def test_exact_dedup_equals_brute_force_even_if_hashes_collide(spark, hash128):
    rows = [(7 - k if k < 6 else 100 + k, t) for k, t in enumerate(TEXTS)] + [(None, "a b"), (None, "only null ids"), (3, "a  b"), (3, "a  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit(1), "key": F.lit(2), "norm": F.lit(3)})
    got = exact_dedup.classes(df, hash128=hash128)
    assert no_python(got)
    assert sorted(map(tuple, got.collect()), key=str) == dedup_brute(rows)


def test_very_long_texts_of_a_conversation_and_of_copies(spark):
    long = "</s>[INST] \\ ok " * 100_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = out.select(F.explode(chat_format.parse(F.col("formatted"))).alias("t")).select("t.*").collect()
    assert [tuple(t) for t in turns] == [("user", long), ("assistant", long)]
    got = exact_dedup.classes(spark.createDataFrame([(2, long), (1, long.replace(" ", "\n ")), (3, long + "x")], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {1: (1, 2), 2: (1, 2), 3: (3, 1)}


def test_drop_copies_keeps_one_row_of_each_class_with_its_columns(spark):
    rows = [(5, "a b", "p"), (2, "a\nb", "q"), (2, "a\nb", "q"), (2, "other", "r"), (None, "solo", "s"), (9, None, "t"), (10, "", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("nth", F.lit(0))
    got = sorted(map(tuple, exact_dedup.drop_copies(df).collect()), key=str)
    assert got == sorted([(2, "a\nb", "q", 0), (2, "other", "r", 0), (None, "solo", "s", 0), (9, None, "t", 0)], key=str)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.classes(docs(spark, [])).count() == 0
    assert exact_dedup.drop_copies(docs(spark, [])).columns == ["doc_id", "text", "lang", "source", "n_chars"]


# -- mixing -----------------------------------------------------------------------------------------------------------


def poisson_inverse(u, rate):
    n, term = 0, math.exp(-rate)
    below = term
    while below <= u:
        n += 1
        term *= rate / n
        below += term
    return n


def test_mixing_equals_brute_force(spark):
    rows = [(i, "x" * (i % 50), "s%d" % (i % 3) if i % 7 else None) for i in range(600)] + [(5, "again", "s1"), (None, "null id", "s2"), (601, None, "s0"), (602, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"rate": F.lit(1), "mix_group": F.lit(2), "u": F.lit(3)})
    weights = {"s0": 0.5, "s1": 0.1, "absent": 0.2}
    got = mixing.mix(df, weights, epochs=2.0, seed="t")
    assert no_python(got)
    group = lambda s: s if s in weights else None
    size = Counter()
    for _, t, s in rows:
        size[group(s)] += len(t or "")
    weight = {g: weights.get(g, 1 - sum(weights.values())) for g in size}
    rate = {g: 2.0 * weight[g] / sum(weight.values()) * sum(size.values()) / size[g] for g in size}
    want = Counter()
    for i, t, s in rows:
        u = int(hashlib.md5(f"t|{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
        for copy in range(1, poisson_inverse(u, rate[group(s)]) + 1):
            want[i, t, s, copy] += 1
    found = got.collect()
    assert Counter((r.doc_id, r.text, r.source, r.mix_copy) for r in found) == want
    assert got.columns == [*df.columns, "mix_rate", "mix_copies", "mix_copy", "mix_key"]
    keys = got.withColumn("p", F.spark_partition_id()).select("p", "mix_key").collect()
    assert [k.mix_key for k in keys] == sorted(k.mix_key for k in keys) or len({k.p for k in keys}) > 1


def test_mixing_at_a_rate_of_a_million(spark):
    rows = [(i, "x" * 1000, "big") for i in range(100)] + [(1000 + i, "y", "tiny") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"tiny": 0.95}
    rate = 0.95 * (100_000 + 2) / 2 * 20
    table = {r.mix_group: r for r in mixing.rates(df, weights, epochs=20.0).collect()}
    assert abs(table["tiny"].rate - rate) < 1e-6 and rate > 900_000 and len(table["tiny"].cdf) < 21 * math.sqrt(rate)
    assert table["tiny"].cdf[0] < 1e-15 and abs(table["tiny"].cdf[-1] - 1) < 1e-12
    got = mixing.mix(df, weights, epochs=20.0).filter("source = 'tiny'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mix_copy").alias("copies"), F.max("mix_copies").alias("told")).collect()
    for r in got:
        assert r.n == r.copies == r.told and abs(r.n - rate) < 6 * math.sqrt(rate)
        u = int(hashlib.md5(f"{mixing.SEED}|{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        below = math.fsum(math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(int(rate - 12 * math.sqrt(rate)), r.n))
        assert abs(below - u) < 0.01 / math.sqrt(rate) + math.exp(r.n * math.log(rate) - rate - math.lgamma(r.n + 1))


@pytest.mark.parametrize("rate", [0.3, 7.0, 499.0, 501.0, 40_000.0])
def test_distribution(spark, rate):
    row = mixing._distributions(spark.createDataFrame([(None, rate)], "mix_group string, rate double")).first()
    exact, below = [], 0.0
    for k in range(row.low + len(row.cdf)):
        below += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        exact.append(below)
    assert max(abs(a - b) for a, b in zip(row.cdf, exact[row.low :], strict=True)) < 1e-9 and (row.low == 0) == (rate < 500)
    if rate < 500:
        assert max(abs(a - b) for a, b in zip(row.cdf, exact, strict=True)) < 1e-12


def test_copies_without_an_id_are_spread(spark):
    rows = [(None, f"text {i}", "s") for i in range(400)] + [(None, "the same", "s")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, {"other": 0.1}, epochs=3.0).withColumn("p", F.spark_partition_id())
    keys = got.filter("text <> 'the same' AND mix_copy = 1").select("text", "mix_key").distinct().collect()
    assert len({r.mix_key for r in keys}) == len(keys) > 300
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(mix_key" in plan and "salt" in plan
    long = mixing.mix(spark.createDataFrame([(1, "x" * 3_000_000, "s")], df.schema), {"other": 0.1}, epochs=2.0).select(F.length("text").alias("n"))
    assert {r.n for r in long.collect()} <= {3_000_000}


def test_mixing_reaches_its_weights_and_refuses_impossible_ones(spark):
    df = spark.createDataFrame([(i, "x" * 20, f"s{i % 2}") for i in range(20_000)], "doc_id long, text string, source string")
    got = {r.source: r["count"] for r in mixing.mix(df, {"s0": 0.8}).groupBy("source").count().collect()}
    assert abs(got["s0"] / 16_000 - 1) < 0.03 and abs(got["s1"] / 4_000 - 1) < 0.06
    large = mixing.mix(df.filter("doc_id < 2"), {"s0": 0.999}, epochs=1500.0).groupBy("source").count().collect()
    assert 2_500 < {r.source: r["count"] for r in large}["s0"] < 3_500
    assert mixing.mix(df.limit(0)).count() == 0
    for bad in ({}, {"s0": 1.0}, {"s0": -0.1}):
        with pytest.raises(ValueError):
            mixing.mix(df, bad)


# -- chat formatting --------------------------------------------------------------------------------------------------


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segments": F.lit(0), "formatted": F.lit(0)})
    out = chat_format.format_conversations(df)
    assert no_python(out)
    return {r.conv_id: r for r in out.withColumn("turns", chat_format.parse(F.col("formatted"))).collect()}


def test_chat_texts_come_back_whatever_they_hold(spark):
    r = random.Random(2)
    parts = [*chat_format.CHAT.controls, "\\", "\\\\", "<", "|", "[", "\n", "é😀", "", "</", "s>", "im_end|>"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "<|im_sep|>", "a\\b", None]), "".join(r.choice(parts) for _ in range(r.randint(0, 9)))) for c in range(60) for t in range(r.randint(1, 6))]
    got = formatted(spark, rows)
    for c in {x[0] for x in rows}:
        own = [(x[2] or "", x[3]) for x in rows if x[0] == c]
        assert [tuple(t) for t in got[c].turns] == own
        bodies = [s.text for s in got[c].segments if s.kind == "text"]
        assert not any(k in b for b in bodies for k in chat_format.CHAT.controls)
        assert [s.loss for s in got[c].segments if s.kind == "text"] == [role == "assistant" for role, _ in own]
        assert "".join(s.text for s in got[c].segments) == got[c].formatted


@pytest.mark.parametrize(
    ("roles", "bad"),
    [("sua", -1), ("ua", -1), ("uaua", -1), ("u", 1), ("su", 2), ("a", 0), ("uu", 1), ("usa", 1), ("uax", 2), ("s", 1), ("ss", 1)],
)
def test_chat_machine(spark, roles, bad):
    names = {"s": "system", "u": "user", "a": "assistant", "x": ""}
    got = formatted(spark, [(1, k, names[c], "t") for k, c in enumerate(roles)])[1]
    assert (got.first_bad_turn, got.valid) == (bad, bad < 0)


def test_chat_nulls_ties_and_nothing(spark):
    got = formatted(spark, [(1, 0, "user", None), (1, None, None, "first"), (1, 0, "assistant", "tie"), (None, 3, "user", "x"), (2, 0, "user", "r"), (2, 0, "user", "r")])
    assert [tuple(t) for t in got[1].turns] == [("", "first"), ("assistant", "tie"), ("user", "")]
    assert len(got[None].turns) == 1 and len(got[2].turns) == 2
    assert formatted(spark, []) == {}


# -- fingerprints -----------------------------------------------------------------------------------------------------


def pieces(text):
    return set(re.findall(rf"[^\n]{{1,{fingerprints.PIECE}}}\n?|\n", text or ""))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_is_exact_for_any_size_of_difference(spark):
    r = random.Random(4)
    pairs = []
    for k in range(60):
        base = [f"p{r.random()}" for _ in range(r.choice([0, 1, 3, 20, 200, 3000 if k % 20 == 0 else 30]))]
        other = [x for x in base if r.random() < 0.7] + [f"q{r.random()}" for _ in range(r.choice([0, 1, 5, 50]))]
        pairs.append(("\n".join(base), "\n".join(other)))
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, x string, y string").repartition(4)
    df = df.select("k", fingerprints.digests(F.col("x")).alias("a"), fingerprints.digests(F.col("y")).alias("b"))
    df = df.withColumns({"sa": fingerprints.sketch(F.col("a")), "sb": fingerprints.sketch(F.col("b"))})
    got = df.select("k", fingerprints.likeness(*map(F.col, ("a", "b", "sa", "sb"))).alias("near"))
    assert no_python(got)
    for row in got.collect():
        assert row.near == pytest.approx(jaccard(*map(pieces, pairs[row.k])))


def test_peeling_recovers_the_digests(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [3, 4, 5])], "a array<bigint>, b array<bigint>")
    found = df.select(fingerprints.peel(fingerprints.subtract(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))).alias("d")).first().d
    assert sorted(found) == [1, 2, 5]


def test_next_document_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_CHARS", 40)
    r = random.Random(5)
    ids = r.sample(range(-1000, 10**12), 60) + [-5, -4, -3]
    rows = [(i, f"text {i}") for i in ids] + [(None, "null id"), (-4, "second"), (ids[0], None), (ids[1], f"text {ids[1]}")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit(0), "guest": F.lit(True), "at": F.lit(1)})
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda x: (-(2**63) if x[0] is None else x[0], x[1]))
    want = Counter((i, t, ordered[(k + 1) % len(ordered)][1]) for k, (i, t) in enumerate(ordered))
    assert Counter((x.doc_id, x.text, x.next_text) for x in fingerprints.with_next(df).collect()) == want
    alone = fingerprints.with_next(spark.createDataFrame([(3, "x")], "doc_id long, text string")).collect()
    assert [(x.doc_id, x.text, x.next_text, x.next_digests == x.digests) for x in alone] == [(3, "x", "x", True)]
    assert fingerprints.with_next(df.limit(0)).count() == 0


def test_ranges_follow_the_ids(spark, monkeypatch):
    """One id far out, and ids in clumps, don't put most rows into one range."""
    monkeypatch.setattr(fingerprints, "RANGE_CHARS", 100)
    ids = [*range(200), *range(10**9, 10**9 + 200), 10**15, -(10**12)]
    ranged = fingerprints._ranged(spark.createDataFrame([(i, "x" * 10) for i in ids], "doc_id long, text string"))
    sizes = sorted(r["count"] for r in ranged.groupBy("part").count().collect())
    assert len(sizes) > 30 and sizes[-1] <= 30 and sum(sizes) == 402
    assert [r.doc_id for r in ranged.orderBy("part", "at").collect()] == sorted(ids)


@NEEDS_DATA
def test_registered_fingerprints_equal_brute_force(spark, tmp_path):
    """Whole rows of the query, near_edited and near_next too, on documents of several shapes."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(10**9, None), (10**9 + 1, ""), (10**9 + 2, "a\n" * 500), (10**9 + 3, "b" * 3000), (10**9 + 4, "\n"), (10**9 + 5, "é😀\nx")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows.sort()
    got = {r.doc_id: r for r in fingerprints.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].near_edited == pytest.approx(jaccard(pieces(text), pieces(edited)))
        assert got[i].near_next == pytest.approx(jaccard(pieces(text), pieces(after)))
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (pieces(text) == pieces(edited))


def test_equal_texts_have_equal_fingerprints(spark):
    got = fingerprints.fingerprints(docs(spark, ["a\nb", "a\nb", "a\nc", None, ""])).orderBy("doc_id").collect()
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint
    assert got[3].fingerprint == got[4].fingerprint
