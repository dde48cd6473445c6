"""Full-text index: covers against brute force, ranked conjunctions, what a search reads, reuse of the stored index."""

import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from engram.sources.text_index import COVER, TextIndex, cover_worth


def plain_worth(entries, groups):
    """All stretches between two entries that hold every group and contain no shorter such stretch."""
    holds = lambda a, b: {g for p, gs in entries if a <= p <= b for g in gs} >= set(range(groups))
    at = [p for p, _ in entries]
    spans = [(a, b) for a, b in [(p, p) for p in at] + list(combinations(at, 2)) if holds(a, b)]
    least = [(a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)]
    worth = sum(COVER // (1 + (b - a + 1) - sum(a <= p <= b for p in at)) for a, b in least)
    return worth, len(least)


def test_covers_equal_brute_force(spark):
    r = random.Random(1)
    rows = []
    for _ in range(150):
        groups = r.randint(1, 4)
        entries = [(p, sorted(r.sample(range(groups), r.randint(1, min(2, groups))))) for p in sorted(r.sample(range(1, 40), r.randint(0, 12)))]
        rows.append((groups, entries))
    made = spark.createDataFrame(rows, "groups int, entries array<struct<place:int,groups:array<int>>>")
    found = made.select("groups", "entries", cover_worth(F.col("entries"), F.col("groups")).alias("found")).collect()
    assert [(x.found.worth, x.found.covers) for x in found] == [plain_worth([tuple(e) for e in x.entries], x.groups) for x in found]


def _corpus(spark, r, n=120):
    words = [f"w{k}" for k in range(25)] + ["Straße", "niño"]
    docs = [(k, " ".join(r.choices(words, range(27, 0, -1), k=r.randint(0, 60)))) for k in range(n)] + [(n, None), (n + 1, ""), (n + 2, "a b c . !")]
    return words, docs, spark.createDataFrame(docs, "doc_id long, text string").withColumns({"term": F.lit(1), "bucket": F.lit("x")})


def test_ranked_conjunctions_equal_brute_force(spark, tmp_path):
    r = random.Random(2)
    words, docs, made = _corpus(spark, r)
    index = TextIndex(spark, str(tmp_path / "index"), buckets=8)
    index.build(made)
    queries = {q: [r.sample(words, r.randint(1, 2)) for _ in range(r.randint(1, 3))] for q in range(12)} | {20: [["w0"], ["unseen"]], 21: [["unseen"]], 22: [["W1", "w1"], ["w1"]]}
    rows = [(q, g, t) for q, groups in queries.items() for g, terms in enumerate(groups) for t in terms]
    got = index.rank(spark.createDataFrame(rows, "query_id long, nth int, term string"), 7).collect()
    want = []
    for q, groups in queries.items():
        groups = [{t.lower() for t in g} for g in groups]
        scored = []
        for i, text in docs:
            words_of = [w.lower() for w in re.findall(r"\w{2,}", text or "")]
            entries = [(p, [g for g, terms in enumerate(groups) if w in terms]) for p, w in enumerate(words_of, 1) if any(w in terms for terms in groups)]
            worth, covers = plain_worth(entries, len(groups))
            if covers:
                scored.append((worth, i, covers))
        want += [(q, i, worth / 1e9, covers, place) for place, (worth, i, covers) in enumerate(sorted(scored, reverse=True)[:7], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    none = spark.createDataFrame([], "query_id long, nth int, term string")
    assert index.rank(none, 7).collect() == []


def test_a_search_reads_the_folders_of_its_terms_only(spark, tmp_path):
    _, _, made = _corpus(spark, random.Random(3))
    index = TextIndex(spark, str(tmp_path / "index"), buckets=16)
    index.build(made)
    queries = spark.createDataFrame([(1, 0, "w3"), (1, 1, "w9")], "query_id long, nth int, term string")
    wanted = {r[0] for r in queries.select(index._bucket(F.col("term"))).collect()}
    read = index.lookup(queries).select(F.input_file_name()).distinct().collect()
    assert {int(re.search(r"bucket=(\d+)", f[0])[1]) for f in read} == wanted
    plan = index.rank(queries, 5)._jdf.queryExecution().executedPlan().toString()
    scans = [re.sub(r"#\d+", "", line) for line in plan.splitlines() if "FileScan" in line and "doc_id" in line]
    assert scans and all("PartitionFilters: [bucket" in line for line in scans)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_stored_index_is_built_once_for_the_same_files(spark, tmp_path):
    _, docs, made = _corpus(spark, random.Random(4))
    path = str(tmp_path / "docs")
    made.select("doc_id", "text").write.parquet(path)
    one = TextIndex.stored(spark.read.parquet(path))
    assert TextIndex.stored(spark.read.parquet(path)).path == one.path
    made.filter("doc_id < 50").select("doc_id", "text").write.mode("overwrite").parquet(path)
    two = TextIndex.stored(spark.read.parquet(path))
    assert two.path != one.path and two.postings().agg(F.max("doc_id")).first()[0] < 50 <= one.postings().agg(F.max("doc_id")).first()[0]


def test_postings_are_put_together_before_the_shuffle(spark, monkeypatch):
    from engram.sources import text_index

    _, docs, made = _corpus(spark, random.Random(5))
    want = sorted((i, t, [p for p, w in enumerate(words, 1) if w == t]) for i, text in docs for words in [[w.lower() for w in re.findall(r"\w{2,}", text or "")]] for t in set(words))
    assert sorted(map(tuple, text_index.placed(made).collect())) == want
    batch = next(iter(made.select("doc_id", F.transform(text_index.T.tokens(F.col("text")), F.lower).alias("words")).toArrow().to_batches()))
    monkeypatch.setattr(text_index, "WORDS_AT_ONCE", 50)
    pieces = list(text_index._put_together(iter([batch])))
    assert len(pieces) > 5 and sorted((r["doc_id"], r["term"], r["places"]) for p in pieces for r in p.to_pylist()) == sorted(w for w in want if w[0] in set(batch.column(0).to_pylist()))


def test_rows_that_repeat_an_id_are_one_document(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), buckets=4)
    index.build(spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc aa"), (2, "aa"), (None, "aa"), (None, "aa dd")], "doc_id long, text string"))
    got = sorted(((r.term, r.doc_id, r.places) for r in index.postings().collect()), key=repr)
    assert got == sorted([("aa", 1, [1, 3, 3]), ("bb", 1, [1, 2]), ("cc", 1, [2]), ("aa", 2, [1]), ("aa", None, [1, 1]), ("dd", None, [2])], key=repr)
