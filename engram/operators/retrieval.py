"""Stages 3 and 4: reciprocal rank fusion of ranked sources, and packing ranked lines into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import token_estimate
from engram.settings import SETTINGS

RRF_K, PER_SOURCE, LIMIT, BUDGET = SETTINGS.rrf_k, SETTINGS.candidates_per_source, SETTINGS.retrieval_limit, SETTINGS.injection_token_budget
HEADER = "Bekannte Fakten:"


def ranks(hits: DataFrame, score: Column, per_source: int = PER_SOURCE) -> DataFrame:
    """``query_id, source, fact_id, place`` of ``query_id, source, fact_id``: the best of each source by ``score`` and id."""
    order = Window.partitionBy("query_id", "source").orderBy(score, "fact_id")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_source).select("query_id", "source", "fact_id", "place")


def fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """``query_id, fact_id, score, sources``: each source votes 1 / (k + place); ``sources`` maps source to place."""
    met = ranked.groupBy("query_id", "fact_id").agg(F.sum(1.0 / (k + F.col("place"))).alias("score"), F.collect_list(F.struct("source", "place")).alias("votes"))
    return met.select("query_id", "fact_id", "score", F.map_from_entries(F.array_sort("votes")).alias("sources"))


def first(fused: DataFrame, visible: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The best visible facts per query; what isn't visible doesn't use up the limit."""
    seen = fused.join(visible, "fact_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "fact_id")
    return seen.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def line(content: Column, valid_from: Column, fact_id: Column) -> Column:
    stamp = F.coalesce(F.date_format(valid_from, "yyyy-MM-dd"), F.lit("?"))
    return F.format_string("- %s (seit %s, Fakt %d)", content, stamp, fact_id)


def pack(ranked: DataFrame, budget: int = BUDGET, header: str = HEADER) -> DataFrame:
    """``query_id, text, included, dropped, tokens_used`` of ``query_id, place, fact_id, line``.

    A line that doesn't fit is skipped and the next one is tried, so this is an ordered fold, not a running sum. What is
    folded is bounded by the retrieval limit.
    """
    met = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "fact_id", "line", token_estimate(F.col("line")).alias("cost")))).alias("all"))
    none = F.array().cast("array<struct<place:int,fact_id:bigint,line:string,cost:int>>")
    start = F.struct(token_estimate(F.lit(header)).alias("used"), none.alias("kept"), none.alias("dropped"))

    def step(acc: Column, x: Column) -> Column:
        x = F.struct(x["place"].cast("int").alias("place"), x["fact_id"].alias("fact_id"), x["line"].alias("line"), x["cost"].alias("cost"))
        fits = acc["used"] + x["cost"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"),
            F.when(fits, acc["dropped"]).otherwise(F.array_append(acc["dropped"], x)).alias("dropped"),
        )

    packed = met.select("query_id", F.aggregate("all", start, step).alias("p"))
    lines = F.transform("p.kept", lambda x: x["line"])
    text = F.when(F.size("p.kept") > 0, F.concat_ws("\n", F.lit(header), F.array_join(lines, "\n"))).otherwise("")
    ids = lambda c: F.transform(c, lambda x: x["fact_id"])
    return packed.select("query_id", text.alias("text"), ids("p.kept").alias("included"), ids("p.dropped").alias("dropped"), F.col("p.used").alias("tokens_used"))
