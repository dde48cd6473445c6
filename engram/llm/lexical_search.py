"""Ranked lexical search: max trees over document ranges per term, searched best-first with exact integer scores.

Terms are the maximal runs of code points other than ASCII punctuation, symbols, controls and spaces, A-Z lower-cased.

1. A task cuts its documents into blocks (at most ``BLOCK_DOCS``, about ``BLOCK_CHARS`` of text) and writes postings: a
   row for each block and term with the documents' places and occurrences as packed integers, and one row for each block
   with ids and lengths. Texts aren't shuffled; nothing is left out, so the index serves any queries.
2. Counts over all documents: documents with a term, terms in all, documents per term.
3. Queries (items) are dealt to groups; a term that a group asks for meets the block's postings of it, so a block and
   a group of items come together with the postings of the asked terms only.
4. In a block, each term has a tree: a leaf for each document with its contribution to a score, above it the greatest
   contribution in ranges of 16, 256, ... documents. Levels are arrays sorted by the node above, so the children of a
   node are one slice. For each item a queue holds nodes by the sum of their terms' greatest contributions; the
   highest is opened until the k-th score found is above it. Nodes whose bound equals that score are opened too,
   as a document there may have the same score and a smaller id.
5. Each block gives at most k rows for an item; the best k of these are ranked. Their number grows with the blocks, so
   what meets for an item is first cut to k per task.

The queries' size isn't assumed: they are joined, never collected. A common term has one row per block, so no term is a hot key.

Defined cases: null and empty texts, and those without terms, are never found and don't count. A very long text is a
block of its own. Rows that repeat an id are documents of their own and can both be ranked. A document without an id counts in the statistics
but has no name to be returned under. Items with a null id, null text or without terms give no rows; rows of items that repeat
an id are one item with the terms of all. No documents or no items give no rows. Only the named columns are read, so others can't clash.
Sums are exact in doubles up to 2^53; a score of a thousand query terms stays below 2.5e13.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from engram.llm.common import id_and_text, table
from engram.session import Scratch

TOP = 10
#: Documents and code points of a block, and items of a group.
BLOCK_DOCS, BLOCK_CHARS, GROUP_ITEMS = 65_536, 6_000_000, 1_024
#: Children of a node of the tree: 2 to the power of this.
BITS = 4
#: Stands for the id of a document without one.
NAMELESS = -(2**63)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_POSTINGS = "block long, term binary, places binary, times binary"


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of unsigned 32-bit integers as binary values, without copying them one by one."""
    offsets = np.append(starts, len(values)).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype("<u4"))])


def _block(number: int, ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of one block. The row without a term has ids and numbers of terms."""
    seen: defaultdict[bytes, int] = defaultdict(count().__next__)
    found = []
    for text in texts:
        words = terms(text)
        found.append(np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words)))
    lengths = np.array([len(x) for x in found], dtype=np.int64)
    pairs, times = np.unique(np.concatenate(found) * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, place = np.divmod(pairs, len(ids))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    names = pa.array([None, *seen], pa.binary())
    own = np.array([NAMELESS if x is None else x for x in ids], dtype="<i8")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(seen) + 1, number), pa.int64()), names,
            pa.concat_arrays([pa.array([own.tobytes()], pa.binary()), _packed(place, starts)]),
            pa.concat_arrays([pa.array([lengths.astype("<u4").tobytes()], pa.binary()), _packed(times, starts)]),
        ],
        names=["block", "term", "places", "times"],
    )


def _indexer(block_docs: int, block_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, chars = None, [], [], 0
        for batch in batches:
            for at, doc_id, text in zip(batch.column("at").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if ids and (len(ids) >= block_docs or chars + len(text) > block_chars):
                    yield _block(number, ids, texts)
                    ids, texts, chars = [], [], 0
                number = at if not ids else number
                ids.append(doc_id)
                texts.append(text)
                chars += len(text)
        if ids:
            yield _block(number, ids, texts)

    return run


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``block, term, places, times``: postings of all documents; the row of a block without a term has its documents.

    A block is named by the task and place of its first row. Write the result before it is used: names are those of one reading.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("at", F.monotonically_increasing_id())
    return rows.select("at", "doc_id", "text").mapInArrow(_indexer(block_docs, block_chars), _POSTINGS)


@F.pandas_udf(LongType())
def _filled(times: pd.Series) -> pd.Series:
    """Numbers above zero in packed integers."""
    return pd.Series([int(np.count_nonzero(np.frombuffer(x, dtype="<u4"))) for x in times])


@F.pandas_udf(LongType())
def _added(times: pd.Series) -> pd.Series:
    return pd.Series([int(np.frombuffer(x, dtype="<u4").sum(dtype=np.int64)) for x in times])


def _weight(documents: int, frequency: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.ln(F.lit(float(2 * documents + 2)) / (2 * frequency + 1).cast("double")))


@F.pandas_udf(ArrayType(BinaryType()))
def _terms(texts: pd.Series) -> pd.Series:
    return texts.map(terms)


def asked(items: DataFrame, postings: DataFrame, documents: int, groups: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``term, part, items, repeats, weight``: for each term that a group of items asks for, which of them and how often."""
    rows = items.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("item IS NOT NULL")
    said = rows.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int")).select("item", "part", F.explode(_terms("text")).alias("term"))
    repeats = said.groupBy("term", "part", "item").agg(F.count(F.lit(1)).alias("repeats"))
    lists = repeats.groupBy("term", "part").agg(F.collect_list(F.struct("item", "repeats")).alias("by"))
    frequency = postings.filter("term IS NOT NULL").groupBy("term").agg(F.sum(F.octet_length("places") / 4).cast("long").alias("frequency"))
    met = lists.join(frequency, "term").withColumn("weight", _weight(documents, F.col("frequency")))
    return met.select("term", "part", F.col("by.item").alias("items"), F.col("by.repeats").alias("repeats"), "weight")


@dataclass
class Level:
    """Nodes of one level by the node above: term, node and greatest contribution, sorted by ``node >> BITS``."""

    term: np.ndarray
    node: np.ndarray
    most: np.ndarray
    starts: np.ndarray

    def children(self, above: int, wanted: np.ndarray) -> np.ndarray:
        """Sum of the wanted terms' contributions for each child of a node."""
        part = slice(self.starts[above], self.starts[above + 1])
        return np.bincount(self.node[part] & ((1 << BITS) - 1), weights=wanted[self.term[part]] * self.most[part], minlength=1 << BITS)


def tree(term: np.ndarray, place: np.ndarray, gain: np.ndarray, places: int) -> list[Level]:
    """Levels from the documents up to a single node; input sorted by term and place."""
    levels, node = [], place
    while True:
        above = node >> BITS
        order = np.argsort(above, kind="stable")
        starts = np.searchsorted(above[order], np.arange(((places - 1) >> BITS) + 2))
        levels.append(Level(term[order], node[order], gain[order], starts))
        if (places := ((places - 1) >> BITS) + 1) == 1:
            return levels
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(above, prepend=-1) != 0))
        term, node, gain = term[first], above[first], np.maximum.reduceat(gain, first)


def best(levels: list[Level], wanted: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """``score, id`` of the k best documents, by score and then smaller id. ``wanted``: repeats of each term."""
    found: list[tuple[int, int]] = []  # the worst one first
    queue = [(-np.inf, len(levels), 0)]
    while queue and (len(found) < k or -queue[0][0] >= found[0][0]):
        _, height, node = heapq.heappop(queue)
        scores = levels[height - 1].children(node, wanted)
        for child in np.flatnonzero(scores > 0).tolist():
            at, score = (node << BITS) + child, scores[child]
            if height > 1:
                if len(found) < k or score >= found[0][0]:
                    heapq.heappush(queue, (-score, height - 1, at))
            elif ids[at] != NAMELESS:
                entry = (int(score), -int(ids[at]))
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
    return [(score, -name) for score, name in sorted(found, reverse=True)]


def _searcher(documents: int, total: int, k: int) -> Callable:
    def search(rows: list[tuple]) -> list[tuple]:
        """Rows of one block and group; the first has the documents."""
        ids, lengths = np.frombuffer(rows[0][0], dtype="<i8"), np.frombuffer(rows[0][1], dtype="<u4").astype(np.int64)
        if len(rows) == 1:
            return []
        norm = 100 - 75 + (75 * lengths * documents) // total
        places = [np.frombuffer(r[0], dtype="<u4").astype(np.int64) for r in rows[1:]]
        sizes = [len(x) for x in places]
        term, place = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(places)
        times = np.concatenate([np.frombuffer(r[1], dtype="<u4") for r in rows[1:]]).astype(np.int64)
        gain = np.repeat(np.array([r[4] for r in rows[1:]], dtype=np.int64), sizes) * ((1_000_000_000 * times) // (1000 * times + 8 * norm[place]))
        levels = tree(term, place, gain, len(ids))
        asks: dict[int, list] = defaultdict(list)
        for at, (_, _, items, repeats, _) in enumerate(rows[1:]):
            for item, n in zip(items.tolist(), repeats.tolist(), strict=True):
                asks[item].append((at, n))
        out, wanted = [], np.zeros(len(sizes), dtype=np.int64)
        for item, of in asks.items():
            at, n = np.array(of).T
            wanted[at] = n
            out += [(item, name, score) for score, name in best(levels, wanted, ids, k)]
            wanted[at] = 0
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []
        for frame in frames:
            for block, part, *row in frame[["block", "part", "places", "times", "items", "repeats", "weight"]].itertuples(index=False):
                if now != (block, part):
                    if rows:
                        yield pd.DataFrame(search(rows), columns=["item_id", "doc_id", "score"]).astype("int64")
                    now, rows = (block, part), []
                rows.append(tuple(row))
        if rows:
            yield pd.DataFrame(search(rows), columns=["item_id", "doc_id", "score"]).astype("int64")

    return run


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block_docs: int = BLOCK_DOCS, block_chars: int = BLOCK_CHARS, group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents for each item, equal scores by id."""
    scratch = Scratch(docs.sparkSession)
    postings = scratch.keep(index(docs, id_col, text_col, block_docs, block_chars))
    result = search_index(postings, items, k, item_col, item_text_col, group_items, scratch)
    scratch.drop_all_but(result)
    return result


def search_index(
    postings: DataFrame, items: DataFrame, k: int = TOP, item_col: str = "item_id", text_col: str = "text", group_items: int = GROUP_ITEMS, scratch: Scratch | None = None,
) -> DataFrame:
    """As ``search``, over a written index."""
    scratch = scratch or Scratch(postings.sparkSession)
    blocks = postings.filter("term IS NULL")
    documents, total = blocks.agg(F.sum(_filled("times")), F.sum(_added("times"))).first()
    groups = max(1, -(-items.count() // group_items))
    wants = scratch.keep(asked(items, postings, documents or 0, groups, item_col, text_col))
    hits = postings.filter("term IS NOT NULL").join(wants, "term").select("block", "part", F.lit(1).alias("kind"), "places", "times", "items", "repeats", "weight")
    nothing = F.array().cast("array<long>")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part")
    heads = blocks.select("block", every, F.lit(0).alias("kind"), "places", "times", nothing.alias("items"), nothing.alias("repeats"), F.lit(0).cast("long").alias("weight"))
    told = heads.union(hits).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    found = told.mapInPandas(_searcher(documents or 0, total or 1, k), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scratch.keep(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FOUND = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_FOUND} FROM documents), tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // total AS m FROM n, s),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY t),
q AS (SELECT item_id, t, count(*) AS r FROM (SELECT item_id, {_FOUND} FROM benchmark) GROUP BY ALL),
found AS (SELECT item_id, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM found WHERE score > 0) WHERE rank <= {TOP}
"""
