"""MinHash near-dedup against brute force, components, and the pipeline's stages."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engram.llm import near_dedup
from engram.llm.common import WordHashes
from engram.llm.components import connected_components
from engram.session import checkpoint_dir

DATA = "/root/testdata/sf0.001"
NEEDS_DATA = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows, linked):
    """Smallest id reachable, for every id."""
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if linked(a, b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def family_docs(seed=5):
    r = random.Random(seed)
    words, texts = [f"w{i}" for i in range(3000)], []
    passage = [r.choice(words) for _ in range(30)]
    for _ in range(10):
        base = [r.choice(words) for _ in range(r.randint(8, 70))]
        for _ in range(r.randint(1, 7)):
            edited = list(base)
            for _ in range(r.randint(0, 3)):
                edited[r.randrange(len(edited))] = r.choice(words)
            base = edited if r.random() < 0.5 else base
            texts.append(" ".join(edited))
    texts += [" ".join(passage + [r.choice(words) for _ in range(20)]) for _ in range(12)]
    texts += ["one", "one", "ONE", "two words", "Two  words", "", None, " \n", "a b c d", "a b c d e", "A B c\td e"]
    r.shuffle(texts)
    return [(k * 3 - 20, t) for k, t in enumerate(texts)]


def check(got, rows):
    want = groups(rows, similar)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(rows)


def test_near_dedup_equals_brute_force(spark):
    rows = family_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("vertex", "key", "bands", "a", "b")})
    got = near_dedup.components(df).collect()
    check(got, rows)
    sizes = {r.doc_id: r.n_shingles for r in got}
    assert sizes == {i: len(shingles(t)) for i, t in rows}


def test_no_link_is_lost_when_all_share_one_bucket(spark):
    rows = family_docs(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(near_dedup.components(df, bucket_keys=lambda found, probes: np.zeros(1, dtype=np.int64)).collect(), rows)


def test_no_link_is_lost_over_several_blocks_and_shares(spark, monkeypatch):
    """Everything in one bucket, blocks of one or two sets, visitors dealt over many tasks, a centre in salted parts."""
    monkeypatch.setattr(near_dedup, "SALT_MEMBERS", 5)
    rows = family_docs(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(near_dedup.components(df, bucket_keys=lambda found, probes: np.zeros(1, dtype=np.int64), block_shingles=60, visit_shingles=200).collect(), rows)


def test_scratch_tables_are_deleted(spark, tmp_path):
    checkpoint_dir(spark)  # set up, so that its name stays
    root = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(root.glob("engram-*"))
    near_dedup.components(spark.createDataFrame(family_docs(8), "doc_id long, text string")).count()
    (own,) = set(root.glob("engram-*")) - before
    assert len(list(own.iterdir())) == 1


def test_near_dedup_edges(spark):
    long = "word%d " * 6 % tuple(range(6)) + " ".join(map(str, range(30_000)))
    rows = [(5, long), (4, long + " end"), (4, "repeated id one two three"), (9, "repeated id one two three"), (None, long), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.components(df).collect()), key=str)
    assert got == sorted([(5, 4, False), (4, 4, True), (4, 4, True), (9, 4, False), (None, None, True), (7, 7, True)], key=str)
    assert near_dedup.components(df.limit(0)).count() == 0
    kept = near_dedup.keep_one(df.withColumn("row", F.lit("x")).withColumn("kept_id", F.lit(0)))
    assert kept.columns == ["doc_id", "text", "row", "kept_id"] and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "7", "None"]


def test_bins_agree_as_often_as_the_sets_are_alike():
    r = np.random.default_rng(1)
    probes = near_dedup._Probes()
    for n in (1, 2, 4, 12, 60, 400, 5000):
        same = []
        for _ in range(300 if n < 1000 else 40):
            pool = r.integers(0, 2**64, size=n + max(1, n // 5), dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[-n:])
            same.append(np.mean(near_dedup.signature(a, probes) == near_dedup.signature(b, probes)))
        alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(np.mean(same) - alike) < 0.06
    assert near_dedup.shingles("a b c d e f", WordHashes()).size == 2


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 500)] + [(1000, 1000), (2001, 2000), (2002, 2001), (2002, 2000)]
    r.shuffle(edges)
    got = {x.vertex: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(500)) and got[2002] == 2000 and 1000 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@NEEDS_DATA
def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"]
    good = stages["quality"](spark, docs, DATA).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns and 0 < len(kept) < before
    assert sum((labels[i] == 1) == (i in kept) for i in labels) / len(labels) > 0.93
    single = stages["exact_dedup"](spark, good, DATA).cache()
    first = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        first.setdefault(" ".join(__import__("re").split(r"[\x20\x09-\x0D]+", r.text or "")), r.doc_id)
    assert {r.doc_id for r in single.collect()} == set(first.values())
    apart = stages["near_dedup"](spark, single, DATA).cache()
    want = groups([(r.doc_id, r.text) for r in single.collect()], similar)
    assert {r.doc_id for r in apart.collect()} == {i for i, c in want.items() if i == c}
    mixed = stages["mixing"](spark, apart, DATA).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in apart.collect()}
    encoded = stages["encoding"](spark, mixed, DATA)
    assert encoded.count() == mixed.count() and encoded.filter("NOT round_trip").count() == 0


@NEEDS_DATA
def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    ran = corpus_pipeline.run(spark, DATA)
    assert sorted(r.doc_id for r in ran.collect()) == sorted(r.doc_id for r in docs.collect())


@NEEDS_DATA
def test_pipeline_over_nulls_clashing_columns_and_no_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"row": F.lit("r"), "score": F.lit(1.5), "rate": F.lit(2), "component_id": F.lit("c"), "kept_id": F.lit(None).cast("string"), "mix_key": F.lit("m")})
    odd = spark.createDataFrame([(-1, None, None, None), (-2, "", "de", "src0"), (None, "No id at all, but a sentence of some length.", "en", None), (-3, "word " * 40_000, "en", "src1"), (-3, "again another text of this id", "en", "src1")], "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(odd.withColumn("n_chars", F.length("text").cast("long")), allowMissingColumns=True)
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        if name != "encoding":
            assert docs.columns == columns and docs.count() > 0 and (name == "mixing" or before is None or docs.count() <= before)
            before = docs.count()
    assert docs.filter("NOT round_trip").count() == 0
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DATA)
        assert empty.count() == 0, name
