"""The corpus pipeline: quality classifier, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the columns of
``documents``; the last returns ids of pieces per row. ``run`` applies them to the table ``documents`` and writes what
each but the last returns to the shared checkpoint folder, so a lost executor never means starting over.

Defined cases: null and empty texts are scored by the classifier like any other and go if it rejects them; those that
stay are one class of equal texts, of which the smallest id stays. Rows without an id are never copies of one another by
id, only by text. Rows that repeat an id and differ in text are both kept until near-dedup, where they are one vertex. A
very long text is one row throughout. Further columns of the documents come along under their own names, whatever those
are. Without documents, or without labels to learn from, every stage gives what it can: no rows, or all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engram.llm import exact_dedup, mixing, near_dedup, quality, sentence_pieces
from engram.llm.common import table
from engram.session import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that score below the threshold go. Learnt from the labels that training may see."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of equal texts, the row with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near-duplicates, the document with the smallest id stays."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each document occurs as often as its source's rate says, in a random order."""
    return mixing.replicate(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: ids of pieces, and whether they decode to the very text."""
    return sentence_pieces.encode(docs)


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("encoding", encode)]

#: SQL can't express a learnt classifier or an encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.keep(docs)
            scratch.drop(before)
    return docs
