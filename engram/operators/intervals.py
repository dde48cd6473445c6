"""Interval joins over dyadic bins: which intervals hold at which instants, and which intervals overlap.

Time is cut into 2^levels leaves. An interval becomes the few dyadic nodes that cover the leaves it holds entirely (at
most two per level, so a fact that never ends costs no more than a short one) and the one or two leaves it begins and ends
in. An instant is looked up under the node above it on each level. The nodes of an interval don't overlap, so a pair meets
exactly once, in an equality join on the node; no pair of tables is compared by a range condition alone.

Nodes with many rows are dealt: intervals of a node to blocks, its instants to parts, each part to each block. Intervals
are half open; a null end never comes, a null or late start (not before the end) holds at no time. Null instants meet nothing. Equality columns
(``keys``), if any, are compared as in a join: null equals nothing. Rows that repeat are pairs of their own. All columns
come back inside the structs ``point`` and ``interval`` (or ``a`` and ``b``), so none can clash.

Where only figures over the pairs are asked for, no pair is made. ``tally_at`` numbers the instants, so that an interval is
a range of numbers; figures are added up per dyadic node and each instant reads those of the nodes above it.
``count_overlaps`` takes from all pairs of two groups those of which one has ended when the other begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.session import Scratch

LEVELS = 12
#: Intervals of a block and instants of a part.
BLOCK_ROWS, PART_ROWS = 4096, 16_384


def _div(x: Column, by: int) -> Column:
    """Whole division of a number that isn't negative; the quotient is small, so rounding the exact multiple is safe."""
    return F.round((x - x % by) / by).cast("long")


def _cover(start: Column, end: Column, width: int, levels: int) -> Column:
    """Nodes (level, number) of an interval of units counted from 0, ``start < end``."""
    a, b = _div(start + (width - 1), width), _div(end, width)  # the leaves that it holds entirely
    leaf = lambda x: F.struct(F.lit(0).alias("level"), _div(x, width).alias("number"))
    nodes = [F.when((start % width != 0) | (a > b), leaf(start)), F.when((end % width != 0) & (a <= b), leaf(end))]
    for k in range(levels + 1):
        size = 1 << k
        first, last = _div(a + (size - 1), size), _div(b, size)
        nodes.append(F.when((first < last) & (first % 2 == 1), F.struct(F.lit(k).alias("level"), first.alias("number"))))
        nodes.append(F.when((first < last) & (last % 2 == 1), F.struct(F.lit(k).alias("level"), (last - 1).alias("number"))))
    return F.array_compact(F.array(*nodes))


def valid_at(points: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = (), levels: int = LEVELS, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """``point, interval``: every row of ``points`` (at: long) with every row of ``intervals`` (start, end: long) that holds then."""
    low, high = points.agg(F.min("at"), F.max("at")).first()
    low, high = (0, 0) if low is None else (low, high)
    width = -(-(high - low + 1) // (1 << levels))
    by = [f"_{k}" for k in range(len(keys))]
    keyed = lambda df, name: df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keys, by, strict=True)], F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))
    spot = ["level", "number", *by]

    inside = keyed(intervals, "interval").withColumns({
        "from": F.greatest(F.col("interval.start"), F.lit(low)) - low,
        "to": F.least(F.coalesce(F.col("interval.end"), F.lit(high + 1)), F.lit(high + 1)) - low,
    }).filter(F.col("interval.start").isNotNull() & (F.col("from") < F.col("to")))
    inside = inside.select(*by, "interval", F.explode(_cover(F.col("from"), F.col("to"), width, levels)).alias("node")).select("node.*", *by, "interval")
    leaf = _div(F.col("point.at") - low, width)
    above = F.array(*[F.struct(F.lit(k).alias("level"), _div(leaf, 1 << k).alias("number")) for k in range(levels + 1)])
    asked = keyed(points, "point").filter("point.at IS NOT NULL").select(*by, "point", F.explode(above).alias("node")).select("node.*", *by, "point")

    number = lambda df, size, name: df.groupBy(*spot).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = number(inside, block_rows, "blocks").join(number(asked, part_rows, "parts"), spot)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda what, n: F.pmod(F.xxhash64(what), F.col(n)).cast("int")
    hosts = inside.join(sizes, spot).select(*spot, dealt("interval", "blocks").alias("block"), upto("parts").alias("part"), "interval")
    guests = asked.join(sizes, spot).select(*spot, upto("blocks").alias("block"), dealt("point", "parts").alias("part"), "point")
    met = guests.join(hosts, [*spot, "block", "part"])
    holds = (F.col("interval.start") <= F.col("point.at")) & (F.col("interval.end").isNull() | (F.col("interval.end") > F.col("point.at")))
    return met.filter(holds).select("point", "interval")


def overlapping(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = (), levels: int = LEVELS, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """``a, b``: every two intervals (start, end: long) with an instant in common, each pair once.

    Either b begins while a holds, or a begins later than b and while b holds.
    """
    begun = lambda df: df.filter("start IS NOT NULL AND (end IS NULL OR start < end)").withColumn("at", F.col("start"))
    packed = lambda df: df.select(*keys, "start", "end", F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))
    a, b = packed(a), packed(b)
    first = valid_at(begun(b), a, keys, levels, block_rows, part_rows).select(F.col("interval.row").alias("a"), F.col("point.row").alias("b"))
    second = valid_at(begun(a), b, keys, levels, block_rows, part_rows).filter("point.at > interval.start").select(F.col("point.row").alias("a"), F.col("interval.row").alias("b"))
    return first.union(second)


def _holds_ever() -> Column:
    return F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("start") < F.col("end")))


def tally_at(points: DataFrame, intervals: DataFrame, value: str, scratch: Scratch | None = None) -> DataFrame:
    """``at, n, least, greatest``: for each distinct instant of ``points`` (at: long) at which any of ``intervals`` holds,
    how many do, and the least and greatest ``value`` among them.

    Work grows with the rows of both tables (times the logarithm of the number of instants), not with the pairs.
    """
    scratch = scratch or Scratch(points.sparkSession)
    figures = F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest")
    spans = intervals.select("start", "end", F.col(f"`{value}`").alias("value")).filter(_holds_ever())
    spans = scratch.keep(spans.groupBy("start", "end").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest")))

    # the number of an instant, and of any other time the number of the instant that comes next: counted within ranges of time
    stated = lambda df, c, asked: df.select(F.col(c).alias("time"), F.lit(asked).alias("asked")).filter("time IS NOT NULL")
    times = stated(points, "at", 1).union(stated(spans, "start", 0)).union(stated(spans, "end", 0)).groupBy("time").agg(F.max("asked").alias("asked"))
    dealt = scratch.keep(times.repartitionByRange("time").withColumn("piece", F.spark_partition_id()))
    sizes = dealt.groupBy("piece").agg(F.sum("asked").alias("asked"))  # a row for each range
    before = sizes.select("piece", (F.sum("asked").over(Window.orderBy("piece")) - F.col("asked")).alias("before"))
    inside = F.sum("asked").over(Window.partitionBy("piece").orderBy("time")) - F.col("asked")
    numbered = scratch.keep(dealt.withColumn("inside", inside).join(F.broadcast(before), "piece").select("time", "asked", (F.col("before") + F.col("inside")).alias("number")))
    total = sizes.agg(F.sum("asked")).first()[0] or 0
    levels = max(1, total - 1).bit_length()

    number = lambda c, name: numbered.select(F.col("time").alias(c), F.col("number").alias(name))
    ranges = spans.join(number("start", "from"), "start").join(number("end", "to"), "end", "left").withColumn("to", F.coalesce("to", F.lit(total))).filter("from < to")
    ranges = ranges.groupBy("from", "to").agg(*figures)
    nodes = ranges.select(F.explode(_cover(F.col("from"), F.col("to"), 1, levels)).alias("node"), "n", "least", "greatest").groupBy("node.level", "node.number").agg(*figures)
    above = F.array(*[F.struct(F.lit(k).alias("level"), _div(F.col("number"), 1 << k).alias("number")) for k in range(levels + 1)])
    asked = numbered.filter("asked = 1").select("time", F.explode(above).alias("node")).select("node.*", "time")
    return asked.join(nodes, ["level", "number"]).groupBy(F.col("time").alias("at")).agg(*figures)


def count_overlaps(intervals: DataFrame, key: str, by: str) -> DataFrame:
    """``<key>, one, other, pairs``: for every two values one < other of ``by`` within a key, how many pairs of their intervals
    have an instant in common; pairs above 0 only.

    Two intervals that ever hold overlap unless one has ended when the other begins, and only one of them can have. So it is
    enough to know, at each beginning, how many intervals of each other value have ended. Work grows with the rows times
    the values that a key has.
    """
    rows = intervals.select(F.col(f"`{key}`").alias("key"), F.col(f"`{by}`").alias("by"), "start", "end").filter(_holds_ever() & F.col("key").isNotNull() & F.col("by").isNotNull())
    kinds = rows.groupBy("key", "by").agg(F.count(F.lit(1)).alias("n"))
    begun = rows.groupBy("key", "by", F.col("start").alias("time")).agg(F.count(F.lit(1)).alias("begun"))
    others = kinds.groupBy("key").agg(F.collect_list("by").alias("all"))
    begun = begun.join(others, "key").select("key", F.col("by").alias("later"), "time", "begun", F.explode("all").alias("sooner")).filter("sooner <> later")
    ended = rows.filter("end IS NOT NULL").select("key", F.col("by").alias("sooner"), F.col("end").alias("time"))
    told = begun.select("key", "sooner", "time", "later", "begun", F.lit(0).alias("ended")).union(ended.select("key", "sooner", "time", F.lit(None), F.lit(0), F.lit(1)))
    gone = F.sum("ended").over(Window.partitionBy("key", "sooner").orderBy("time"))  # those that end at this very time included
    told = told.withColumn("gone", gone).filter("later IS NOT NULL")
    apart = told.groupBy("key", F.least("sooner", "later").alias("one"), F.greatest("sooner", "later").alias("other")).agg(F.sum(F.col("gone") * F.col("begun")).alias("apart"))
    n = lambda name: kinds.select("key", F.col("by").alias(name), F.col("n").alias(f"n_{name}"))
    pairs = apart.join(n("one"), ["key", "one"]).join(n("other"), ["key", "other"]).select(F.col("key").alias(key), "one", "other", (F.col("n_one") * F.col("n_other") - F.col("apart")).alias("pairs"))
    return pairs.filter("pairs > 0")
