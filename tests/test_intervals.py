"""Interval joins against plain range joins: edges of bins, open and empty intervals, nulls, hot nodes, keys, clashing names."""

import random
from collections import Counter

import pytest

from engram.operators.intervals import count_overlaps, overlapping, tally_at, valid_at


def tables(seed):
    r = random.Random(seed)
    draw = lambda: r.choice([r.randint(0, 1000), 64 * r.randint(0, 15), None if r.random() < 0.2 else 500])
    points = [(k, r.choice(["x", "y", None]), draw()) for k in range(60)]
    intervals = [(k, r.choice(["x", "y", None]), draw(), draw()) for k in range(80)] + [(900, "x", -50, 2000), (901, "x", None, None), (902, "y", 1000, None), (902, "y", 1000, None)]
    return points, intervals


def frames(spark, points, intervals):
    return (
        spark.createDataFrame(points, "level long, subject string, at long").repartition(2),
        spark.createDataFrame(intervals, "level long, subject string, start long, end long").repartition(3),
    )


@pytest.mark.parametrize("keys", [(), ("subject",)])
@pytest.mark.parametrize(("levels", "block", "part"), [(12, 4096, 4096), (4, 3, 2), (0, 5, 7)])
def test_valid_at_equals_a_range_join(spark, keys, levels, block, part):
    points, intervals = tables(levels)
    p, i = frames(spark, points, intervals)
    got = valid_at(p, i, keys, levels, block, part)
    want = Counter(
        (x, y) for x in points for y in intervals
        if x[2] is not None and y[2] is not None and y[2] <= x[2] and (y[3] is None or y[3] > x[2]) and (not keys or x[1] == y[1] is not None)
    )
    assert Counter((tuple(r.point), tuple(r.interval)) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("keys", [(), ("subject",)])
def test_overlapping_counts_each_pair_once(spark, keys):
    _, a = tables(5)
    _, b = tables(6)
    fa, fb = (spark.createDataFrame(x, "row long, subject string, start long, end long") for x in (a, b))
    some = lambda x: x[2] is not None and (x[3] is None or x[2] < x[3])
    want = Counter(
        (x, y) for x in a for y in b
        if some(x) and some(y) and (y[3] is None or x[2] < y[3]) and (x[3] is None or y[2] < x[3]) and (not keys or x[1] == y[1] is not None)
    )
    assert Counter((tuple(r.a), tuple(r.b)) for r in overlapping(fa, fb, keys, 5, 6, 7).collect()) == want


def test_empty_tables(spark):
    p, i = frames(spark, *tables(1))
    for x, y in ((p.limit(0), i), (p, i.limit(0)), (p.limit(0), i.limit(0)), (p.filter("at IS NULL"), i)):
        assert valid_at(x, y).collect() == []


def test_an_endless_interval_costs_as_little_as_a_short_one(spark):
    from pyspark.sql import functions as F

    from engram.operators.intervals import _cover

    rows = spark.range(0, 4096).select(F.col("id").alias("a"), F.lit(4096 * 10).alias("b"))
    most = rows.select(F.size(_cover(F.col("a") * 10 + 3, F.col("b"), 10, 12)).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 2 * 12 + 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tally_equals_a_range_join_and_makes_no_pair(spark, seed):
    points, intervals = tables(seed)
    p, i = frames(spark, points, intervals)
    got = {r.at: (r.n, r.least, r.greatest) for r in tally_at(p, i, "level").collect()}
    held = lambda at: [y[0] for y in intervals if y[2] is not None and y[2] <= at and (y[3] is None or y[3] > at)]
    want = {x[2]: (len(h), min(h), max(h)) for x in points if x[2] is not None and (h := held(x[2]))}
    assert got == want
    for x, y in ((p.limit(0), i), (p, i.limit(0)), (p.filter("at IS NULL"), i)):
        assert tally_at(x, y, "level").collect() == []


def test_tally_costs_no_row_per_pair(spark):
    from pyspark.sql import functions as F

    points = spark.range(20_000).select(F.col("id").alias("at"))
    facts = spark.range(20_000).select(F.col("id").alias("fact"), F.lit(-1).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))  # 4e8 pairs
    found = tally_at(points, facts, "fact").agg(F.count("*"), F.min("n"), F.max("n"), F.min("least"), F.max("greatest")).first()
    assert tuple(found) == (20_000, 20_000, 20_000, 0, 19_999)


@pytest.mark.parametrize("seed", [1, 5])
def test_counted_overlaps_equal_the_pairs(spark, seed):
    r = random.Random(seed)
    _, rows = tables(seed)
    rows = [(r.choice(["u", "v", None]), kind, start, end) for _, kind, start, end in rows + rows[:40]]
    rows += [("w", "x", 1, 5), ("w", "y", 5, 9), ("w", "z", 4, None), ("w", "z", 7, 7)]
    some = [x for x in rows if x[0] and x[1] and x[2] is not None and (x[3] is None or x[2] < x[3])]
    want = Counter((a[0], a[1], b[1]) for a in some for b in some if a[0] == b[0] and a[1] < b[1] and (b[3] is None or a[2] < b[3]) and (a[3] is None or b[2] < a[3]))
    df = spark.createDataFrame(rows, "subject string, kind string, start long, end long").repartition(3)
    assert Counter({(x.subject, x.one, x.other): x.pairs for x in count_overlaps(df, "subject", "kind").collect()}) == want
    assert count_overlaps(df.limit(0), "subject", "kind").collect() == []


def test_counted_overlaps_cost_no_row_per_pair(spark):
    from pyspark.sql import functions as F

    rows = spark.range(40_000).select(F.lit(1).alias("subject"), (F.col("id") % 2).alias("kind"), F.col("id").alias("start"), F.lit(None).cast("long").alias("end"))  # 4e8 pairs
    assert [tuple(x) for x in count_overlaps(rows, "subject", "kind").collect()] == [(1, 0, 1, 400_000_000)]
