"""Chain index against a plain search: random graphs, merges, circles, branches, a long chain, appended links."""

import random

import pytest
from pyspark.sql import functions as F

from engram.operators.chains import ChainIndex
from engram.operators.history import descendants
from engram.session import Scratch


def reach(links, root):
    seen, waiting = {root}, [root]
    while waiting:
        x = waiting.pop()
        for a, b in links:
            if a == x and b not in seen:
                seen.add(b)
                waiting.append(b)
    return seen


def graph(seed):
    r = random.Random(seed)
    links = [(a, a + r.randint(1, 3)) for a in range(40) for _ in range(r.randint(0, 2))]  # chains, branches, merges
    links += [(r.randint(0, 45), r.randint(0, 45)) for _ in range(r.randint(0, 8))]  # circles, links to itself
    return links + links[:3]


def made(spark, links):
    return spark.createDataFrame(links + [(None, 3), (5, None)], "parent_id long, fact_id long").withColumn("place", F.lit("x"))


@pytest.mark.parametrize("seed", range(4))
def test_descendants_and_closure_equal_a_plain_search(spark, tmp_path, seed):
    links = graph(seed)
    index = ChainIndex(spark, str(tmp_path / "index"))
    index.build(made(spark, links))
    roots = [0, 7, 20, 20, 99]
    asked = spark.createDataFrame([(x,) for x in roots], "root long")
    got = [r.fact_id for r in index.descendants(asked).collect()]
    assert len(got) == len(set(got)) and set(got) == set().union(*(reach(links, x) for x in roots))
    assert set(got) == {r.fact_id for r in descendants(made(spark, links), asked).collect()}
    pairs = [tuple(r) for r in index.closure(asked).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(x, y) for x in roots for y in reach(links, x)}


def test_appended_links(spark, tmp_path):
    links = graph(9)
    index = ChainIndex(spark, str(tmp_path / "index"))
    index.build(made(spark, links[:30]))
    index.append(made(spark, links[30:60]))
    index.append(made(spark, [*links[60:], (44, 100), (100, 101), (101, 2)]))
    links = [*links, (44, 100), (100, 101), (101, 2)]
    ids = sorted({x for e in links for x in e})
    pairs = {tuple(r) for r in index.closure(spark.createDataFrame([(x,) for x in ids], "root long")).collect()}
    assert pairs == {(x, y) for x in ids for y in reach(links, x)}


def test_a_chain_of_ten_thousand_takes_one_round(spark, tmp_path):
    chain = spark.range(1, 10_000).select((F.col("id") - 1).alias("parent_id"), F.col("id").alias("fact_id"))
    index = ChainIndex(spark, str(tmp_path / "index"))
    index.build(chain)
    assert index.jumps().count() == 0 and index.nodes().agg(F.max("place"), F.countDistinct("chain")).first() == (9999, 1)
    with Scratch(spark) as scratch:
        found = index.descendants(spark.createDataFrame([(17,), (400,)], "root long"), scratch=scratch)
        assert found.count() == 10_000 - 17 and len(scratch.paths) == 3  # the start, an empty round, the result


def test_scratch_is_gone_after_use(spark):
    with Scratch(spark) as scratch:
        kept = scratch.keep(spark.range(5))
        path = next(iter(scratch.paths))
        assert kept.count() == 5 and scratch.keep_new(spark.range(0)) is None and scratch.keep_new(spark.range(2)).count() == 2
        store, target = scratch._files(path)
        assert store.exists(target)
    assert not store.exists(target)


def test_no_links(spark, tmp_path):
    index = ChainIndex(spark, str(tmp_path / "index"))
    index.build(made(spark, []))
    assert [r.fact_id for r in index.descendants(spark.createDataFrame([(4,), (4,)], "root long")).collect()] == [4]
