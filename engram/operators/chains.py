"""A chain index over derivations: what follows from a fact is a range of its chain, not a pair for each descendant.

Every fact gets at most one main parent (its latest earlier one) and one main child (the earliest that chose it), so
main links form disjoint chains along rising ids; a fact's label is (chain, place). All links that aren't main (merges,
branches, circles) are kept between labels. A forward link within a chain says nothing new, and of the links between two
chains one that starts no later and leads no earlier than another is worthless, so few remain.

What is reachable from (chain, place) is, for each chain, everything from some place on. A search therefore carries one
place per chain: a round follows the remaining links out of the ranges found so far and keeps what begins earlier. The
rounds are as many as the changes of chain on the way, whatever the number of versions; circles and merges end by
themselves, since a place only falls.

Places are found by pointer doubling (a chain of n takes log2 n rounds over the unfinished facts), once for an index.
Later links are appended as chains of their own. Tables lie in the shared checkpoint folder or wherever the index is
written; nothing is collected. Links of a fact to itself and repeated links count once; null ends are no links. A fact
without links is its own only descendant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.session import Scratch, stored, tasks_for

_NODES, _JUMPS = "fact_id long, chain long, place long", "chain long, place long, to_chain long, to_place long"


def links_of(lineage: DataFrame, fact: str = "fact_id", parent: str = "parent_id") -> DataFrame:
    """``above, below``, each link once."""
    return lineage.select(F.col(parent).cast("long").alias("above"), F.col(fact).cast("long").alias("below")).filter("above <> below").distinct()


def _main(links: DataFrame) -> DataFrame:
    """``above, below`` of the main links."""
    chosen = links.filter("above < below").groupBy("below").agg(F.max("above").alias("above"))
    return chosen.groupBy("above").agg(F.min("below").alias("below"))


def _placed(ends: DataFrame, main: DataFrame, scratch: Scratch, tasks: int) -> DataFrame:
    """``fact_id, chain, place``: each fact's first ancestor along main links, and how many links away that is."""
    start = ends.repartition(tasks, "fact_id").join(main.select(F.col("below").alias("fact_id"), "above").repartition(tasks, "fact_id"), "fact_id", "left")
    start = scratch.keep(start.select("fact_id", F.coalesce("above", "fact_id").alias("at"), F.col("above").isNotNull().cast("long").alias("place")))
    heads = start.filter("at = fact_id")
    done, active = [heads.select("fact_id", F.col("at").alias("chain"), "place")], start.filter("at <> fact_id")
    while active is not None:
        # a fact whose pointer is at a finished fact is finished; else its pointer's pointer is twice as far
        finished = reduce(DataFrame.union, done).select(F.col("fact_id").alias("at"), F.col("chain").alias("then"), F.col("place").alias("more"), F.lit(True).alias("over"))
        going = active.select(F.col("fact_id").alias("at"), F.col("at").alias("then"), F.col("place").alias("more"), F.lit(False).alias("over"))
        moved = scratch.keep_new(active.repartition(tasks, "at").join(finished.union(going).repartition(tasks, "at"), "at").select("fact_id", F.col("then").alias("at"), (F.col("place") + F.col("more")).alias("place"), "over"))
        if moved is None:
            break
        done.append(moved.filter("over").select("fact_id", F.col("at").alias("chain"), "place"))
        active = moved.filter("NOT over").select("fact_id", "at", "place")
    return reduce(DataFrame.union, done)


def _jumps(links: DataFrame, nodes: DataFrame, tasks: int) -> DataFrame:
    """The links between labels that a search needs."""
    above = nodes.select(F.col("fact_id").alias("above"), "chain", "place")
    below = nodes.select(F.col("fact_id").alias("below"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    dealt = lambda df, c: df.repartition(tasks, c)
    between = dealt(dealt(links, "above").join(dealt(above, "above"), "above"), "below").join(dealt(below, "below"), "below").filter("chain <> to_chain OR to_place < place")
    first = between.groupBy("chain", "place", "to_chain").agg(F.min("to_place").alias("to_place"))
    later = Window.partitionBy("chain", "to_chain").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("before", F.min("to_place").over(later)).filter("before IS NULL OR to_place < before").select("chain", "place", "to_chain", "to_place")


class ChainIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def stored(cls, lineage: DataFrame, what: str = "lineage", fact: str = "fact_id", parent: str = "parent_id") -> ChainIndex:
        """The index of a derived table of files, built when these files have none yet; ``what`` names the derivation."""
        spark = lineage.sparkSession
        return cls(spark, stored(lineage, f"chains {what} {fact} {parent}", lambda own: cls(spark, own).build(lineage, fact, parent)))

    def build(self, lineage: DataFrame, fact: str = "fact_id", parent: str = "parent_id") -> None:
        """Write the index anew."""
        self._write(links_of(lineage, fact, parent), "overwrite")

    def append(self, lineage: DataFrame, fact: str = "fact_id", parent: str = "parent_id") -> None:
        """Add links, between known and new facts alike; new facts form chains of their own."""
        self._write(links_of(lineage, fact, parent), "append")

    def _write(self, links: DataFrame, mode: str) -> None:
        with Scratch(self.spark) as scratch:
            links = scratch.keep(links)
            tasks = tasks_for(self.spark, links.count())
            ends = links.select(F.col("above").alias("fact_id")).union(links.select("below")).distinct()
            inner = links
            if mode == "append":
                ends = scratch.keep(ends.join(self.nodes(), "fact_id", "left_anti"))
                inner = links.join(ends.withColumnRenamed("fact_id", "above"), "above", "left_semi").join(ends.withColumnRenamed("fact_id", "below"), "below", "left_semi").select("above", "below")
            nodes = scratch.keep(_placed(ends, _main(inner), scratch, tasks))
            known = nodes if mode == "overwrite" else self.nodes().union(nodes)
            jumps = scratch.keep(_jumps(links, known, tasks))
            nodes.repartitionByRange("chain", "place").sortWithinPartitions("chain", "place").write.mode(mode).parquet(f"{self.path}/nodes")
            jumps.write.mode(mode).parquet(f"{self.path}/jumps")

    def nodes(self) -> DataFrame:
        """``fact_id, chain, place``."""
        return self.spark.read.schema(_NODES).parquet(f"{self.path}/nodes")

    def jumps(self) -> DataFrame:
        """``chain, place, to_chain, to_place``."""
        return self.spark.read.schema(_JUMPS).parquet(f"{self.path}/jumps")

    def descendants(self, roots: DataFrame, root: str = "root", scratch: Scratch | None = None) -> DataFrame:
        """``fact_id``: the roots and everything below any of them, each once."""
        return self._below(roots.select(F.col(root).alias("fact_id")).distinct(), [], scratch)

    def closure(self, roots: DataFrame, root: str = "root", scratch: Scratch | None = None) -> DataFrame:
        """``root, fact_id``: every root with itself and all its descendants."""
        return self._below(roots.select(F.col(root).alias("root"), F.col(root).alias("fact_id")).distinct(), ["root"], scratch)

    def _below(self, start: DataFrame, keys: list[str], scratch: Scratch | None) -> DataFrame:
        scratch = scratch or Scratch(self.spark)
        nodes, jumps = self.nodes(), self.jumps()
        begun = start.join(nodes, "fact_id").groupBy(*keys, "chain").agg(F.min("place").alias("place"))
        found = [scratch.keep(begun)]
        new = found[0]
        while new is not None:
            out = jumps.select("chain", F.col("place").alias("leaves"), "to_chain", "to_place")
            met = new.join(out, "chain").filter("leaves >= place").groupBy(*keys, F.col("to_chain").alias("chain")).agg(F.min("to_place").alias("place"))
            known = reduce(DataFrame.union, found).groupBy(*keys, "chain").agg(F.min("place").alias("known"))
            new = scratch.keep_new(met.join(known, [*keys, "chain"], "left").filter("known IS NULL OR place < known").select(*keys, "chain", "place"))
            if new is not None:
                found.append(new)
        ranges = found[0] if len(found) == 1 else reduce(DataFrame.union, found).groupBy(*keys, "chain").agg(F.min("place").alias("place"))
        inside = nodes.select("fact_id", "chain", F.col("place").alias("at"))
        below = ranges.join(inside, "chain").filter("at >= place").select(*keys, "fact_id")
        whole = scratch.keep(below.union(start.join(nodes, "fact_id", "left_anti").select(*keys, "fact_id")))
        scratch.drop(*found)
        return whole
