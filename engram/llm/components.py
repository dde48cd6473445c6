"""Connected components of an edge table, by label propagation with label jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.session import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", known: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``vertex, component`` (the smallest vertex reachable) for every vertex of an edge.

    A round gives each vertex the smallest label among its own and its neighbours' and then the label of that label, so
    a component is done in about log2 of its diameter rounds. The edges have a loop at each vertex, so one aggregation
    sees both the old label and the offers; the minimum is combined before the shuffle. Both tables of each join have
    been written, so their sizes are known to the optimizer and adaptive execution can split the rows of a vertex with
    very many edges. ``known``: vertex, component of an earlier run over part of the edges, to start from. No edges give
    no rows. All but the last table are deleted from ``scratch``.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    ends = edges.select(F.col(a).alias("vertex"), F.col(b).alias("other")).filter("vertex <> other")
    loops = F.explode(F.array(F.struct("vertex", "other"), F.struct(F.col("other").alias("vertex"), F.col("vertex").alias("other")), F.struct("vertex", F.col("vertex").alias("other")), F.struct(F.col("other").alias("vertex"), "other")))
    both = ends.select(loops.alias("e")).select("e.*")
    if known is not None:  # labels only ever fall, so those of a part of the edges are a fair start
        both = both.union(known.select("vertex", F.col("vertex").alias("other")))
    both = scratch.keep(both.distinct())
    labels = both.filter("vertex = other").select("vertex", F.col("vertex").alias("component"))
    if known is not None:
        labels = labels.join(known.select("vertex", F.col("component").alias("before")), "vertex", "left").select("vertex", F.coalesce("before", "component").alias("component"))
    labels = scratch.keep(labels)
    while True:
        near = both.join(labels.select(F.col("vertex").alias("other"), F.col("component").alias("offer")), "other")
        hooked = near.groupBy("vertex").agg(F.min("offer").alias("hooked"), F.max(F.when(F.col("vertex") == F.col("other"), F.col("offer"))).alias("old"))
        jump = labels.select(F.col("vertex").alias("hooked"), F.col("component").alias("jumped"))
        least = F.least("hooked", "jumped")
        after = scratch.keep(hooked.join(jump, "hooked", "left").select("vertex", least.alias("component"), (F.col("old") != least).alias("changed")))
        scratch.drop(labels)
        labels = after
        if labels.filter("changed").isEmpty():
            scratch.drop(both)
            return labels.select("vertex", "component")
