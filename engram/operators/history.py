"""Lineage: histories, transitive closure. Graph: neighbourhood of seeds. Rounds over written tables, nothing is collected.

A fact may have several parents (merges), and links may run in circles: every pair counts once, and every closure ends.
Each round's new rows are written to the shared checkpoint folder, once, and never again; only the result's table stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.session import Scratch


def _links(lineage: DataFrame, fact: str, parent: str) -> DataFrame:
    return lineage.filter(F.col(parent).isNotNull()).select(F.col(parent).alias("above"), F.col(fact).alias("below")).filter("above <> below").distinct()


def closure(lineage: DataFrame, roots: DataFrame, root: str = "root", fact: str = "fact_id", parent: str = "parent_id") -> DataFrame:
    """``root, fact_id``: every root and all its descendants. A frontier moves down one level per round from the roots."""
    return _descend(_links(lineage, fact, parent), roots.select(F.col(root).alias("root"), F.col(root).alias("fact_id")).distinct(), ["root"])


def descendants(lineage: DataFrame, roots: DataFrame, root: str = "root", fact: str = "fact_id", parent: str = "parent_id") -> DataFrame:
    """``fact_id``: the roots and everything below any of them, each once. Work follows the number of facts found."""
    return _descend(_links(lineage, fact, parent), roots.select(F.col(root).alias("fact_id")).distinct(), [])


def _descend(links: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    scratch, all_keys = Scratch(links.sparkSession), [*keys, "fact_id"]
    links = scratch.keep(links)
    found = [scratch.keep(start)]
    while True:
        below = found[-1].join(links, F.col("fact_id") == F.col("above")).select(*keys, F.col("below").alias("fact_id")).distinct()
        new = scratch.keep(below.join(reduce(DataFrame.union, found), all_keys, "left_anti"))
        if new.isEmpty():
            break
        found.append(new)
    whole = scratch.keep(reduce(DataFrame.union, found))
    scratch.drop_all_but(whole)
    return whole


def closure_by_doubling(lineage: DataFrame, facts: DataFrame, fact: str = "fact_id", parent: str = "parent_id") -> DataFrame:
    """``root, fact_id`` of all ``facts`` (and of what the links name): each under all its ancestors and itself.

    After round k the pairs of all walks shorter than 2^k are known, and ``hops`` has those of exactly 2^k links. A chain
    of n links takes log2(n) rounds. A round without a new pair is the last: nothing is further away.
    """
    scratch = Scratch(lineage.sparkSession)
    links = _links(lineage, fact, parent)
    hops = scratch.keep(links)
    ids = facts.select(F.col(fact).alias("fact_id")).union(hops.select("above")).union(hops.select("below")).distinct()
    found = [scratch.keep(ids.select(F.col("fact_id").alias("root"), "fact_id"))]
    while True:
        seen = reduce(DataFrame.union, found)
        further = seen.join(hops, F.col("root") == F.col("below")).select(F.col("above").alias("root"), "fact_id").distinct()
        new = scratch.keep(further.join(seen, ["root", "fact_id"], "left_anti"))
        if new.isEmpty():
            break
        found.append(new)
        twice = hops.select("above", F.col("below").alias("middle")).join(hops.select(F.col("above").alias("middle"), "below"), "middle").select("above", "below").distinct()
        before, hops = hops, scratch.keep(twice)
        scratch.drop(before)
    whole = scratch.keep(reduce(DataFrame.union, found))
    scratch.drop_all_but(whole)
    return whole


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, duplicates kept: ``node, other``."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2, seed: str = "node") -> DataFrame:
    """``fact_id, hop``: facts of all edges at the nodes within ``hops`` of a seed; hop is the nearest such node's plus one.

    So ``hops`` = 2 reaches facts three edges away. The bound is small and fixed: unrolled joins, distinct per level.
    """
    near = adjacency(edges).distinct()
    level = seeds.select(F.col(seed).alias("node")).distinct().withColumn("hop", F.lit(0))
    nodes = level
    for n in range(1, hops + 1):
        level = level.join(near, "node").select(F.col("other").alias("node")).distinct().withColumn("hop", F.lit(n))
        nodes = nodes.union(level)
    nearest = nodes.groupBy("node").agg(F.min("hop").alias("hop"))
    ends = edges.select(F.col("src").alias("node"), "fact_id").union(edges.select("dst", "fact_id"))
    return ends.join(nearest, "node").groupBy("fact_id").agg((F.min("hop") + 1).alias("hop"))
