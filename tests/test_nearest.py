"""Top-k by blocks against brute force, the inverted file's recall, what is left out, plans without a cross join."""

import random
from collections import Counter

import numpy as np
import pytest

from engram.operators.nearest import IvfIndex, by_occurrences, top_k


def plain(queries, rows, k, score):
    out = []
    for q, group, asked in queries:
        found = [(-s, i) for i, g, p in rows if g == group and g is not None and p is not None and (s := score(asked, p)) is not None]
        out += [(q, i, -s, n) for n, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(np.round(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300), 6))


@pytest.mark.parametrize(("block", "part"), [(3, 2), (16, 5), (4096, 4096)])
def test_blocks_equal_brute_force(spark, block, part):
    r = random.Random(block)
    vector = lambda: [float(r.randint(-2, 2)) for _ in range(3)]
    rows = [(k, r.choice(["a", "a", "b"]), vector()) for k in range(90)] + [(7, "a", [0.0, 0.0, 0.0]), (500, None, vector()), (501, "a", None)]
    queries = [(k, r.choice(["a", "b", "c"]), vector()) for k in range(20)]
    frame = lambda x: spark.createDataFrame(x, "id long, group string, payload array<double>").repartition(3)
    got = top_k(frame(queries), frame(rows), 5, block_rows=block, part_queries=part)
    found, want = sorted(map(tuple, got.collect())), plain(queries, rows, 5, cosine)
    assert [(q, i, n) for q, i, _, n in found] == [(q, i, n) for q, i, _, n in want]
    assert np.allclose([s for _, _, s, _ in found], [s for _, _, s, _ in want], atol=2e-6)
    assert "NestedLoop" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
    assert top_k(frame(queries), frame(rows).limit(0), 5).collect() == top_k(frame(queries).limit(0), frame(rows), 5).collect() == []


@pytest.mark.parametrize("block", [4, 1000])
def test_occurrences_equal_brute_force(spark, block):
    r = random.Random(block)
    rows = [(k, "x", [min(int(r.expovariate(0.3)), 30) for _ in range(r.randint(0, 25))]) for k in range(60)]
    queries = [(k, "x", r.sample(range(35), r.randint(0, 6))) for k in range(15)]
    frame = lambda x: spark.createDataFrame(x, "id long, group string, payload array<long>")
    got = sorted(map(tuple, top_k(frame(queries), frame(rows), 4, by_occurrences, block_rows=block).collect()))
    score = lambda asked, said: float(n) if (n := sum(Counter(said)[t] for t in asked)) else None
    assert got == plain(queries, rows, 4, score)


@pytest.mark.parametrize("spread", [0.1, 5.0])
def test_inverted_file_finds_nine_in_ten_and_indexes_every_row(spark, tmp_path, spread):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16))
    vectors = middle[rng.integers(0, 12, 1500)] + spread * rng.normal(size=(1500, 16))
    vectors[700:900] = vectors[700]  # a third of a cell is one vector
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(None, [1.0] * 16), (9000, None)], "id long, payload array<double>")
    index = IvfIndex(spark, str(tmp_path / "index"))
    index.build(rows)
    assert index.rows().count() == 1500 and index.rows().select("cell").distinct().count() > 20
    assert index.probes() < (6 if spread == 0.1 else 39)
    asked = rows.filter("id % 20 = 0")
    got = {(r.query_id, r.vec_id) for r in index.search(asked, 10).collect()}
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = np.round(units[::20] @ units.T, 6)
    want = {(20 * q, int(i)) for q, s in enumerate(near) for i in np.lexsort((np.arange(1500), -s))[:10]}
    assert len(got & want) >= 0.9 * len(want)
    every = {(r.query_id, r.vec_id) for r in index.search(asked, 10, probes=1500).collect()}
    assert every == want


def test_inverted_file_of_few_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, payload array<double>")
    for name, some in (("two", rows), ("one", rows.limit(1)), ("none", rows.limit(0))):
        index = IvfIndex(spark, str(tmp_path / name))
        index.build(some)
        assert index.search(rows, 3, probes=5).count() == 2 * some.count()


def test_long_rows_come_in_blocks_of_fewer_rows(spark, monkeypatch):
    def small(texts):
        assert len(texts) < 30, "one block"
        return by_occurrences(texts)

    rows = spark.createDataFrame([(k, "g", [k % 7, *range(100, 180)]) for k in range(40)], "id long, group string, payload array<long>")
    asked = spark.createDataFrame([(900, "g", [3])], "id long, group string, payload array<long>")
    monkeypatch.setattr("engram.operators.nearest.BLOCK_NUMBERS", 500)
    found = top_k(asked, rows, 3, small)
    assert [(x.vec_id, x.score) for x in found.orderBy("place").collect()] == [(3, 1.0), (10, 1.0), (17, 1.0)]
