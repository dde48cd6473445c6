"""Two large tables of statements compared by digests, so that only what differs is read.

A table is written in folders by a hash range of the subject, with a tree of digests beside it: ranges over subjects over
time buckets. A digest is the number of statements and two order-free sums of their 64-bit hashes. A comparison goes down
from the ranges: equal digests end it there, and the statements of differing buckets only are read and joined. The
numbers of the differing ranges (at most ``ranges``) are all that is collected.

Two different sets of statements have one digest with probability 2^-128, for hashes taken as random. Statements that
repeat within a subject count once, in the earliest of their buckets. Null subjects and null statements are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGES = 32
_SUMS = ("n", "mixed", "total")


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_xor("mixed").alias("mixed"), (F.sum(F.col("total").cast("decimal(38,0)")) % (1 << 62)).cast("long").alias("total"))


class DigestedTable:
    """Distinct statements ``subject_id, said, bucket`` under a path, with their digests."""

    def __init__(self, spark: SparkSession, path: str, ranges: int = RANGES):
        self.spark, self.path, self.ranges = spark, path, ranges

    def build(self, rows: DataFrame) -> None:
        """Write ``rows`` (subject_id long, said string, bucket string) anew."""
        rows = rows.filter("subject_id IS NOT NULL AND said IS NOT NULL").groupBy("subject_id", "said").agg(F.min("bucket").alias("bucket"))
        dealt = rows.withColumn("range", F.pmod(F.xxhash64("subject_id"), F.lit(self.ranges)).cast("int"))
        dealt.repartition("range").write.partitionBy("range").mode("overwrite").parquet(f"{self.path}/rows")
        one, other = F.xxhash64("subject_id", "said"), F.pmod(F.xxhash64("said", F.lit("other"), "subject_id"), F.lit(1 << 62))
        leaves = _sums(self.rows().select("range", "subject_id", "bucket", F.lit(1).cast("long").alias("n"), one.alias("mixed"), other.alias("total")), "range", "subject_id", "bucket")
        subjects = _sums(leaves, "range", "subject_id").withColumn("bucket", F.lit(None).cast("string"))
        whole = _sums(subjects, "range").withColumns({"subject_id": F.lit(None).cast("long"), "bucket": F.lit(None).cast("string")})
        levels = [df.select(F.lit(name).alias("level"), "range", "subject_id", "bucket", *_SUMS) for name, df in (("leaf", leaves), ("subject", subjects), ("range", whole))]
        reduce(DataFrame.union, levels).write.partitionBy("level").mode("overwrite").parquet(f"{self.path}/digests")

    def rows(self) -> DataFrame:
        return self.spark.read.schema("subject_id long, said string, bucket string, range int").parquet(f"{self.path}/rows")

    def digests(self, level: str) -> DataFrame:
        """``range, subject_id, bucket, n, mixed, total`` of a level: leaf, subject or range."""
        columns = "range int, subject_id long, bucket string, n long, mixed long, total long, level string"
        return self.spark.read.schema(columns).parquet(f"{self.path}/digests").filter(F.col("level") == level).drop("level")


def _differing(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys whose digests aren't the same on both sides."""
    left, right = (df.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys), *keys, F.struct(*_SUMS).alias(name)) for df, name in ((a, "a"), (b, "b")))
    both = left.join(right.drop(*keys), [f"_{k}" for k in keys], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(*[f"_{k}" for k in keys])


def differences(a: DigestedTable, b: DigestedTable) -> DataFrame:
    """``subject_id, said, side`` (``only_original``, ``only_replay``) of the statements that one of the tables lacks."""
    if a.ranges != b.ranges:
        raise ValueError("both tables need the same number of ranges")
    apart = [int(r[0]) for r in _differing(a.digests("range"), b.digests("range"), "range").collect()]
    within = lambda df: df.filter(F.col("range").isin(apart))
    subjects = _differing(within(a.digests("subject")), within(b.digests("subject")), "subject_id").select(F.col("_subject_id").cast("long").alias("subject_id"))
    near = lambda df: within(df).join(subjects, "subject_id", "left_semi")
    leaves = _differing(near(a.digests("leaf")), near(b.digests("leaf")), "subject_id", "bucket").select(F.col("_subject_id").cast("long").alias("subject_id"), F.col("_bucket").alias("leaf"))

    def read(table: DigestedTable, side: str) -> DataFrame:
        rows = near(table.rows()).withColumn("leaf", F.coalesce("bucket", F.lit("")))
        return rows.join(leaves, ["subject_id", "leaf"], "left_semi").select("subject_id", "said", F.lit(True).alias(side))

    met = read(a, "a").join(read(b, "b"), ["subject_id", "said"], "full_outer").filter("a IS NULL OR b IS NULL")
    return met.select("subject_id", "said", F.when(F.col("b").isNull(), "only_original").otherwise("only_replay").alias("side"))
