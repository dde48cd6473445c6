"""A stored positional full-text index and the ranking by cover density that it is searched with.

Postings (term, document, places of the term in it) lie as Parquet in a folder per hash bucket of the term, sorted by
term, so a search reads the folders of its terms only and within them the row groups whose range of terms fits. Beside
them a small table counts documents and occurrences per term. Building is one shuffle of a row per term of a document (not
per word: equal words of a text are put together before it, on Arrow columns); the postings of a term lie in
``SPREAD`` files, dealt by document, so that a word which nearly all documents have is no task of its own.

A ranked query is a list of groups of terms: a document must hold a term of every group (alternatives within a group,
all groups). A cover is a shortest stretch of a document that does; its worth is 0.1 / (1 + words in it that the query
doesn't name), and a document's score is the sum over its covers, kept in integers of 1e-9 so that sums don't depend on
their order. With one group every occurrence is a cover, so the score is a tenth of the occurrences.

Candidates of a query come from its rarest group only; the postings of its other terms are looked up for those
documents, so a frequent term adds no row per document that has it unless all groups of the query are frequent.

Null and empty texts have no postings. Rows that repeat an id are one document whose words lie side by side. Places
count words of two or more characters. A query without groups, and one with a group that nothing matches, find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.session import stored

BUCKETS, SPREAD = 64, 8
#: Words that a task puts together at once (whole documents; at least one).
WORDS_AT_ONCE = 500_000
#: Worth of a cover without foreign words, in 1e-9 (fixed value: a tenth).
COVER = 100_000_000


def places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, place, term``: a row per word, places from 1."""
    words = F.transform(T.tokens(F.col(text_col)), F.lower)
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words).alias("before", "term")).select("doc_id", (F.col("before") + 1).alias("place"), "term")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, term, occurrences``; equal terms of a document are added up before the shuffle."""
    return places(docs, id_col, text_col).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("occurrences"))


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, term, places`` of ``doc_id, words``: a row per distinct word of each row."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
        low = 0
        while low < len(ends):
            most = (ends[low - 1] if low else 0) + WORDS_AT_ONCE
            high = max(low + 1, int(np.searchsorted(ends, most, "right")))
            yield _gathered(batch.slice(low, high - low))
            low = high


def _gathered(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, lists = batch.column(0), batch.column(1)
    lengths, words = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = (np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1).astype(np.int32)
    code = words.indices.to_numpy()
    key = row * max(1, len(words.dictionary)) + code
    order = np.argsort(key, kind="stable")  # so places stay in order
    firsts = np.flatnonzero(np.diff(key[order], prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(order)).astype(np.int32)), pa.array(place[order]))
    first = order[firsts]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row[first])), words.dictionary.take(pa.array(code[first])), lists], names=["doc_id", "term", "places"])


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, term, places``: a row per distinct term of each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.transform(T.tokens(F.col(text_col)), F.lower).alias("words"))
    return rows.mapInArrow(_put_together, "doc_id long, term string, places array<int>")


def cover_worth(entries: Column, groups: Column) -> Column:
    """``worth, covers`` of one document. ``entries``: array of (place, groups of the term there), by place.

    One pass: ``last`` has the latest entry of each group. A stretch from the least of these to the current entry is a
    cover when its start has moved on, else it contains an earlier one.
    """
    none = F.struct(F.lit(0).alias("place"), F.lit(0).alias("nth"))
    start = F.struct(F.array_repeat(none, groups).alias("last"), F.lit(0).alias("nth"), F.lit(0).alias("begun"), F.lit(0).cast("long").alias("worth"), F.lit(0).alias("covers"))

    def step(acc: Column, entry: Column) -> Column:
        nth = acc["nth"] + 1
        here = F.struct(entry["place"].alias("place"), nth.alias("nth"))
        last = F.transform(acc["last"], lambda x, g: F.when(F.array_contains(entry["groups"], g), here).otherwise(x))
        least = F.array_min(last)
        new = least["place"] > acc["begun"]
        foreign = (entry["place"] - least["place"]) - (nth - least["nth"])
        return F.struct(
            last.alias("last"), nth.alias("nth"), F.when(new, least["place"]).otherwise(acc["begun"]).alias("begun"),
            (acc["worth"] + F.when(new, F.floor(F.lit(COVER) / (F.lit(1) + F.greatest(foreign, F.lit(0))))).otherwise(F.lit(0))).alias("worth"),
            (acc["covers"] + new.cast("int")).alias("covers"),
        )

    return F.aggregate(entries, start, step, lambda acc: F.struct(acc["worth"].alias("worth"), acc["covers"].alias("covers")))


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    @classmethod
    def stored(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> TextIndex:
        """The index of a table of files, in the shared checkpoint folder; built when these very files have none yet."""
        spark = docs.sparkSession
        path = stored(docs, f"text {id_col} {text_col} {buckets}", lambda own: cls(spark, own, buckets).build(docs, id_col, text_col))
        return cls(spark, path, buckets)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def build(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Write the index anew."""
        rows = placed(docs, id_col, text_col).withColumns({"bucket": self._bucket(F.col("term")), "part": F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int")})
        met = rows.repartition("bucket", "part")
        if not docs.groupBy(id_col).count().filter("count > 1").isEmpty():
            met = met.groupBy("bucket", "part", "term", "doc_id").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
        met = met.select("term", "doc_id", "places", "bucket")
        met.sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/postings")
        counts = self.postings().groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("places")).alias("occurrences"))
        counts.write.mode("overwrite").parquet(f"{self.path}/terms")

    def postings(self) -> DataFrame:
        """``term, doc_id, places, bucket``."""
        return self.spark.read.schema("term string, doc_id long, places array<int>, bucket int").parquet(f"{self.path}/postings")

    def terms(self) -> DataFrame:
        """``term, documents, occurrences``."""
        return self.spark.read.schema("term string, documents long, occurrences long").parquet(f"{self.path}/terms")

    def search(self, terms: list[str], k: int | None = None) -> DataFrame:
        """``doc_id, score``: occurrences of any of the terms, the ``k`` best or all; ties go to the greater id."""
        met = F.lit(False)
        for term in sorted({t.lower() for t in terms}):  # hashes of literals are folded, so the scan is pruned to their folders
            met = met | ((F.col("bucket") == self._bucket(F.lit(term))) & (F.col("term") == term))
        found = self.postings().filter(met).groupBy("doc_id").agg(F.sum(F.size("places")).alias("score"))
        return found if k is None else found.orderBy(F.desc("score"), F.desc("doc_id")).limit(k)

    def lookup(self, terms: DataFrame) -> DataFrame:
        """Postings that can have one of the ``terms`` (term): the scan is pruned to their folders, whose numbers (at most ``buckets``) are collected."""
        wanted = sorted(r[0] for r in terms.select(self._bucket(F.col("term")).alias("b")).distinct().collect())
        return self.postings().filter(F.col("bucket").isin(wanted))

    def rank(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """``query_id, doc_id, score, covers, place`` of ``queries`` (query_id, nth, term); ``nth`` numbers the groups of a query from 0.

        Equal scores go to the greater id. ``score`` is the sum of the covers' worths.
        """
        asked = queries.select("query_id", "nth", F.lower("term").alias("term")).distinct()
        sizes = asked.groupBy("query_id").agg((F.max("nth") + 1).cast("int").alias("groups"))
        by_term = asked.groupBy("query_id", "term").agg(F.sort_array(F.collect_set("nth")).alias("groups_of"))
        counted = asked.join(self.terms(), "term").groupBy("query_id", "nth").agg(F.sum("documents").alias("documents"))
        rarest = counted.groupBy("query_id").agg(F.min(F.struct("documents", "nth")).alias("least"), F.count(F.lit(1)).alias("met"))
        whole = rarest.join(sizes, "query_id").filter(F.col("met") == F.col("groups")).select("query_id", F.col("least.nth").alias("nth"), "groups")
        rows = self.lookup(asked)
        leads = asked.join(whole, ["query_id", "nth"]).select("query_id", "term", "groups")
        candidates = rows.select("term", "doc_id").join(leads, "term").select("query_id", "groups", "doc_id").distinct()
        wanted = candidates.join(by_term, "query_id")
        entries = F.transform("places", lambda p: F.struct(p.alias("place"), F.col("groups_of").alias("groups")))
        met = rows.join(wanted, ["term", "doc_id"]).groupBy("query_id", "doc_id").agg(F.first("groups").alias("n"), F.array_sort(F.flatten(F.collect_list(entries))).alias("entries"))
        scored = met.select("query_id", "doc_id", cover_worth(F.col("entries"), F.col("n")).alias("found")).filter("found.covers > 0")
        order = Window.partitionBy("query_id").orderBy(F.desc("found.worth"), F.desc("doc_id"))
        ranked = scored.withColumn("place", F.row_number().over(order))
        if k is not None:
            ranked = ranked.filter(F.col("place") <= k)
        return ranked.select("query_id", "doc_id", (F.col("found.worth") / 1e9).alias("score"), F.col("found.covers").cast("long").alias("covers"), F.col("place").cast("long").alias("place"))
