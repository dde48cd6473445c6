"""Exact dedup: rows of one 128-bit content hash form a group, bytes are compared in it, the smallest id stays.

Texts are equal when they are identical after each run of ASCII white space is replaced by one space. Grouping is by
hash *and* bytes, so a collision only makes two classes of one hash. Copies are counted on the map side, so a class of
any size sends one row for each task; members then meet their class on two digests (128 and 256 bits), in narrow rows,
in a join whose hot keys adaptive execution splits.

Defined cases: a null text is an empty one. A very long text is grouped whole, once; beyond that only its digests move. A null id never is the smallest; a class with null ids only has a null
``keep_id`` and its rows count as kept. Rows that repeat an id and its text are all the kept row in ``classes``; the
filter ``drop_copies`` keeps one of them. No rows give no rows. Other columns are neither read nor needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import SPACES, id_and_text, packed, table


def content_hash(text: Column) -> Column:
    return F.md5(text)


def _normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct text: hash and bytes are both keys, so equal hashes alone never join two texts."""
    return (
        rows.groupBy("key", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", _normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "norm", hash128(F.col("norm")).alias("key"))
    members = rows.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"))
    return members.join(_classes(rows), ["key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat a kept id and its text, one."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", _normalised(F.col("text")).alias("norm"))
    stay = _classes(rows.select("doc_id", "norm", hash128(F.col("norm")).alias("key"))).select("keep_id", "key", "text_sha256")
    whole = docs.select(packed(docs).alias("row"), F.col(id_col).cast("long").alias("own_id"), _normalised(F.col(text_col)).alias("norm"))
    whole = whole.select("row", "own_id", hash128(F.col("norm")).alias("own_key"), F.sha2("norm", 256).alias("own_sha"))
    same = (F.col("own_id").eqNullSafe(F.col("keep_id"))) & (F.col("own_key") == F.col("key")) & (F.col("own_sha") == F.col("text_sha256"))
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    first = F.row_number().over(Window.partitionBy("own_id", "own_key", "own_sha").orderBy(F.xxhash64(*plain)))
    return whole.join(stay, same, "left_semi").withColumn("nth", first).filter("nth = 1").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
c AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, c.keep_id, c.group_size, d.doc_id = c.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN c ON d.norm = c.norm
"""
