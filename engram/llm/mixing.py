"""Mixing sources to target weights by Poisson replication.

A source with target weight w gets ``w * epochs * all characters`` characters on average: its documents are repeated
at the mean rate r = that / the source's own characters. The count of each document is the inverse of the Poisson(r)
distribution at a number in [0, 1) hashed from seed and id, so a rerun or a lost executor gives the same copies. The
copies are then dealt over all partitions by a hash of seed, id and copy, and sorted by it: a global shuffle in one
exchange that no source, however large, can make uneven. Equal keys (rows that repeat an id) are dealt further by place.

Sources without a weight of their own share the rest in proportion to their size (one rate for all of them), so the
table of rates has as many rows as declared weights and one more, whatever the data: that bounds what is broadcast.
Weights of sources without any character go to the others in proportion. A tiny source with a weight has a very high
rate; its distribution takes some 20 roots of the rate of numbers, and its copies are made in runs of RUN.

Defined cases: null text has no characters; a null source is one without a declared weight. A very long text is a row
like any other. Equal ids (also null ones) get equal counts, each row on its own; the order of rows without an id
follows a hash of the row. Documents of a source without characters occur once at rate ``epochs``.
No rows give no rows. Columns of the input are kept as they are; the operator's own are put into ``mix_*``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import packed, table

#: Production weights; all other sources share the rest.
WEIGHTS = {"src0": 0.20, "src1": 0.08, "src2": 0.02}
SEED = "mix-1"
#: Rates from which on Stirling's series is exact to the last bits; copies of a document that are made at once; parts of equal keys.
LARGE, RUN, SALTS = 500, 10_000, 1024


def _uniform(seed: str, key: Column) -> Column:
    """52 bits of a digest as a number in [0, 1)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def _distributions(rates: DataFrame) -> DataFrame:
    """``mix_group, rate, low, cdf``: P(N <= k) for k from ``low`` on, as far as the tails are below the 52 bits of a uniform number.

    That is some 20 roots of the rate, so far fewer numbers than a single document of that rate has copies. They are
    rows summed up by a window; those of small rates start at 0, those of large ones come from Stirling's series.
    """
    r, k, large = F.col("rate"), F.col("k"), F.col("rate") >= LARGE
    reach = F.lit(10.0) * F.sqrt("rate") + F.lit(30.0)
    low = F.when(large, F.floor(r - reach)).otherwise(F.lit(0)).cast("long")
    rows = rates.withColumn("low", low).withColumn("k", F.explode(F.sequence("low", F.ceil(r + reach).cast("long"))))
    upto = Window.partitionBy("mix_group").orderBy("k")
    by_product = -r + F.sum(F.when(k > 0, F.log("rate") - F.log(k.cast("double"))).otherwise(F.lit(0.0))).over(upto)
    n = k.cast("double")
    stirling = (n - r) - n * F.log1p((n - r) / r) - F.log(F.lit(2 * math.pi) * n) / 2 - 1 / (12 * n) + 1 / (360 * n * n * n)
    below = rows.withColumn("p", F.exp(F.when(large, stirling).otherwise(by_product))).withColumn("below", F.sum("p").over(upto))
    met = below.groupBy("mix_group").agg(F.first("rate").alias("rate"), F.min("low").alias("low"), F.array_sort(F.collect_list("below")).alias("cdf"))
    return met.select("mix_group", "rate", "low", "cdf")


def rates(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``mix_group, rate, low, cdf``: at most one row for each declared weight and one for the rest."""
    size = F.sum(F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long")).alias("chars")
    sizes = docs.select(_group(weights, source_col).alias("mix_group"), F.col(text_col)).groupBy("mix_group").agg(size)
    target = F.lit(1.0 - sum(weights.values()))
    for name, weight in weights.items():
        target = F.when(F.col("mix_group") == name, F.lit(weight)).otherwise(target)
    sized = sizes.select("mix_group", "chars", F.when(F.col("chars") > 0, target).otherwise(F.lit(0.0)).alias("weight"))
    whole = sized.agg(F.sum("chars").cast("double").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("chars") > 0, F.lit(float(epochs)) * F.col("weight") / F.col("all_weight") * F.col("all_chars") / F.col("chars")).otherwise(F.lit(float(epochs)))
    return _distributions(sized.join(F.broadcast(whole)).select("mix_group", rate.alias("rate")))


def _group(weights: dict[str, float], source_col: str) -> Column:
    """The source if it has a weight of its own, else null."""
    return F.when(F.col(source_col).isin(*weights), F.col(source_col)) if weights else F.lit(None).cast("string")


def mix(
    docs: DataFrame, weights: dict[str, float] = WEIGHTS, epochs: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """The columns of ``docs``, and ``mix_rate, mix_copies, mix_copy`` (from 1) and ``mix_key``, the global order."""
    return _mixed(docs, weights, epochs, seed, id_col, source_col, text_col).select("row.*", "mix_rate", "mix_copies", "mix_copy", "mix_key")


def replicate(
    docs: DataFrame, weights: dict[str, float] = WEIGHTS, epochs: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """The rows of ``mix`` in its order, with the columns of ``docs`` only, whatever they are called."""
    return _mixed(docs, weights, epochs, seed, id_col, source_col, text_col).select("row.*")


def _mixed(docs: DataFrame, weights: dict[str, float], epochs: float, seed: str, id_col: str, source_col: str, text_col: str) -> DataFrame:
    if not weights or min(weights.values()) <= 0 or sum(weights.values()) >= 1:
        raise ValueError("weights must be positive and leave a share for the other sources")
    table_of_rates = F.broadcast(rates(docs, weights, epochs, source_col, text_col))
    rows = docs.select(packed(docs).alias("row"), F.col(id_col).alias("mix_id"), _group(weights, source_col).alias("own_group"))
    rows = rows.join(table_of_rates, F.col("own_group").eqNullSafe(F.col("mix_group")))
    u = _uniform(seed, F.col("mix_id"))
    found = F.col("low") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    rows = rows.withColumn("u", u).withColumn("mix_copies", found.cast("int")).filter("mix_copies > 0").select("row", "mix_id", F.col("rate").alias("mix_rate"), "mix_copies")
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("mix_copies") - 1) / RUN).cast("int"))))
    copy = F.explode(F.sequence(F.col("run") * RUN + 1, F.least(F.col("mix_copies"), (F.col("run") + 1) * RUN)))
    copies = runs.select("row", "mix_id", "mix_rate", "mix_copies", copy.alias("mix_copy"))
    name = F.coalesce(F.col("mix_id").cast("string"), F.concat(F.lit("null|"), F.xxhash64("row").cast("string")))
    key = F.md5(F.concat(F.lit(f"{seed}|order|"), name, F.lit("|"), F.col("mix_copy").cast("string")))
    keyed = copies.withColumn("mix_key", F.substring(key, 1, 16)).withColumn("salt", F.monotonically_increasing_id() % SALTS).drop("mix_id")
    return keyed.repartition("mix_key", "salt").sortWithinPartitions("mix_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.round("mix_rate", 9).alias("mix_rate"), "mix_copies", "mix_copy", "mix_key", "text")


def _oracle(weights: dict[str, float], seed: str) -> str:
    names = ", ".join(f"'{n}'" for n in weights)
    case = " ".join(f"WHEN '{n}' THEN {w!r}" for n, w in weights.items())
    return f"""
WITH d AS (SELECT *, CASE WHEN source IN ({names}) THEN source END AS g FROM documents),
s AS (SELECT g, sum(length(coalesce(text, ''))) AS chars FROM d GROUP BY g),
w AS (SELECT g, chars, CASE WHEN chars > 0 THEN CASE g {case} ELSE {1.0 - sum(weights.values())!r} END ELSE 0 END AS weight FROM s),
r AS (SELECT g, CASE WHEN chars > 0 THEN weight / (sum(weight) OVER ()) * (sum(chars) OVER ()) / chars ELSE 1 END AS rate FROM w),
k AS (SELECT g, rate, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 31)::BIGINT)) AS k FROM r),
c AS (SELECT g, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) AS below FROM k),
u AS (SELECT doc_id, source, text, g, ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {float(16**13)!r} AS u FROM d),
n AS (SELECT u.doc_id, u.source, u.text, c.rate, count(*) FILTER (c.below <= u.u) AS copies
      FROM u JOIN c ON u.g IS NOT DISTINCT FROM c.g GROUP BY ALL),
x AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n WHERE copies > 0)
SELECT doc_id, source, round(rate, 9) AS mix_rate, copies::INTEGER AS mix_copies, copy::INTEGER AS mix_copy,
       substr(md5('{seed}|order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy), 1, 16) AS mix_key, text
FROM x
"""


ORACLE_SQL = _oracle(WEIGHTS, SEED)
