"""LM scoring with stupid backoff: n-gram count tables partitioned by hash, met by the n-grams of the documents.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; n-grams don't reach over the ends of a document. With counts f
over all documents and N words in all, the score of word i is

    S_k = f_k(i) / f_{k-1}(its context)  if f_k(i) >= min_count, else alpha * S_{k-1};  S_1 = f_1(i) / N,

from k = min(order, i + 1), and a document's score is the sum of their logarithms. n-grams seen once aren't in the count
tables of order 2 and above (``min_count`` 2), which is what backing off is for.

The relational plan, with rows packed so that an n-gram of a block of documents costs some 6 bytes, not a whole row:

1. The documents that a task reads are gathered into blocks of about BLOCK_CHARS. A block goes on as one row of word
   hashes: its vocabulary, most frequent first, and a place in it per word. Texts are read once and never shuffled.
2. A block explodes its n-grams, adds up equal ones and sends them on by hash: one row per block and hash partition.
   Beyond FAN_OUT partitions that is done in levels: a block sends to at most FAN_OUT ranges of the hash, as many blocks
   are added up within a range, and the sum is sent on to the parts of the range. A block so has at most FAN_OUT rows,
   however many blocks and partitions there are; every level adds a passage of the (ever fewer) distinct n-grams.
3. A hash partition of the count table adds the blocks' counts and answers each row that it got with the totals, which
   go back the same way. A frequent n-gram has one entry for each sender at most, so it can't make a partition large.
4. A block meets its answers, looks up the counts of each word in place, and sums per document. Steps 2 and 4 read the
   same exchange of blocks.

Defined cases: null, empty and blank texts have no words, score 0 and a null mean. A very long text isn't cut: the block
that it ends is as long as it is, so a task takes some 60 bytes a character of the longest text. Rows that repeat an id are scored
each, and count each. A null id is a row like any other. No rows give no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import WordHashes, id_and_text, mixed, table, windows, words_of

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
#: Characters of a block, and blocks whose n-grams a hash partition of the count table is sized for. A larger block adds
#: up more n-grams before the shuffle and takes more memory: on large executors, raise ``block_chars`` with the input.
BLOCK_CHARS, BLOCKS_A_BUCKET = 12_000_000, 1
#: Rows that a block sends per order at most, and senders whose rows are added up at once. A row then still has some KB of
#: n-grams; a second level (beyond some 49 GB of text) is a further passage of them, so it comes late.
FAN_OUT = 4096


def _pack(numbers: np.ndarray) -> bytes:
    """Bytes of like weight together, which is what a compressor makes use of."""
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw, width = np.frombuffer(zstandard.decompress(data), dtype=np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


_REQUEST = ["node", "owner", "k", "path", "keys", "counts"]


def _kind(level: int) -> type:
    """Counts of one block fit 32 bits, sums over blocks may not."""
    return np.int32 if level == 1 else np.int64


def _plan(blocks: int, buckets: int, fan_out: int) -> tuple[int, int, list[int]]:
    """How many levels, ranges per level, and groups of senders on each level (from 1; one on the last)."""
    levels = 1
    while fan_out**levels < buckets:
        levels += 1
    wide = 1
    while wide**levels < buckets:
        wide += 1
    groups = [blocks]
    for _ in range(levels - 1):
        groups.append(-(-groups[-1] // max(wide, 2)))
    return levels, wide, [*groups, 1]


class _Block:
    """The words of a block of documents. n-grams of one length exist at a time: memory doesn't grow with the order."""

    def __init__(self, row: pd.Series):
        self.ids, self.sizes = _unpack(row["ids"], np.int64), _unpack(row["sizes"], np.int64)
        self.null = _unpack(row["null"], np.uint8).astype(bool)
        self.words = _unpack(row["vocabulary"], np.uint64)[_unpack(row["places"], np.int32)]
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams of k words end, and the n-grams."""
        ends = np.flatnonzero(self.place >= k - 1)
        return ends, windows(self.words, k)[ends - (k - 1)] if len(ends) and k > 1 else self.words[ends]

    def counts(self, k: int, totals: np.ndarray) -> np.ndarray:
        """For each word the count of the n-gram that ends there, 0 without one; ``totals`` ascend by n-gram."""
        found, (ends, grams) = np.zeros(len(self.words), dtype=np.int64), self.grams(k)
        if len(ends):
            found[ends] = totals[np.unique(grams, return_inverse=True)[1]]
        return found

    @staticmethod
    def pack(block: int, ids: list[int | None], each: list[np.ndarray]) -> tuple:
        vocabulary, places, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        null = np.array([i is None for i in ids])
        numbers = np.array([0 if i is None else i for i in ids], dtype=np.int64), null.astype(np.uint8), np.array([len(x) for x in each], dtype=np.int64)
        return (block, *map(_pack, numbers), _pack(vocabulary[order]), _pack(rank[places]))

    def scores(self, totals: Callable[[int], np.ndarray], order: int, words: int, alpha: float, min_count: int) -> np.ndarray:
        """Sum of log scores per document."""
        context = self.counts(1, totals(1))
        log_score = np.log(context / words) if len(context) else np.zeros(0)
        for k in range(2, order + 1):
            found = self.counts(k, totals(k))
            seen, backs_off = found >= max(min_count, 1), self.place >= k - 1
            log_score[backs_off] += np.log(alpha)
            ends = np.flatnonzero(seen)
            log_score[ends] = np.log(found[ends] / context[ends - 1])
            context = found
        owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        return np.bincount(owner, weights=log_score, minlength=len(self.sizes))


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per document: ``doc_id, n_words, log_score, mean_log_score``."""
    rows = id_and_text(docs, id_col, text_col)
    chars, words = rows.select(F.sum(F.length("text")), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()
    parts, words = int(chars or 0) // block_chars + 1, int(words or 0)
    levels, wide, groups = _plan(parts, -(-parts // BLOCKS_A_BUCKET), fan_out)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task, number = WordHashes(), TaskContext.get().partitionId(), 0
        ids, each, size = [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, _Block.pack(task << 32 | number, ids, each), strict=True))], schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(doc_id)
                each.append(hashes.of(words_of(text)))
                size += len(text)
                if size >= block_chars:
                    yield close()
                    ids, each, size, number = [], [], 0, number + 1
        if ids:
            yield close()

    def split(owner: int, group: int, k: int, keys: np.ndarray, counts: np.ndarray, level: int) -> Iterator[tuple]:
        """A row for each range of the hash on a level; ranges ascend with the keys."""
        path = (((keys >> np.uint64(32)) * np.uint64(wide**levels)) >> np.uint64(32)) // np.uint64(wide ** (levels - level))
        first = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1]))) if len(keys) else []
        for lo, hi in pairwise([*first, len(keys)]):
            yield group * wide**level + int(path[lo]), owner, k, int(path[lo]), _pack(np.diff(keys[lo:hi], prepend=np.uint64(0))), _pack(counts[lo:hi].astype(_kind(level)))

    def explode(frame: pd.DataFrame) -> pd.DataFrame:
        block, owner, out = _Block(frame.iloc[0]), int(frame["block"].iat[0]), []
        group = int(mixed(np.array([owner], dtype=np.uint64))[0]) % groups[1]
        for k in range(1, order + 1):
            keys, counts = np.unique(block.grams(k)[1], return_counts=True)
            out += split(owner, group, k, keys, counts, 1)
        return pd.DataFrame(out, columns=_REQUEST)

    def added(rows: pd.DataFrame, level: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Distinct keys, their counts, and for each row where its keys are among them."""
        keys = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in rows["keys"]]
        ends = np.cumsum([len(x) for x in keys])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        totals = np.bincount(inverse, weights=np.concatenate([_unpack(x, _kind(level)) for x in rows["counts"]])).astype(np.int64)
        return distinct, totals, np.split(inverse, ends[:-1])

    def answers_to(rows: pd.DataFrame, totals: np.ndarray, places: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"owner": rows["owner"], "k": rows["k"], "path": rows["path"], "totals": [_pack(totals[x]) for x in places]})

    def pass_on(level: int) -> Callable:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            node, out = int(frame["node"].iat[0]), []
            group = node // wide**level * groups[level + 1] // groups[level]
            for k, rows in frame.groupby("k", sort=True):
                keys, counts, _ = added(rows, level)
                out += split(node, group, k, keys, counts, level + 1)
            return pd.DataFrame(out, columns=_REQUEST)

        return run

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in frame.groupby("k", sort=True):
            _, totals, places = added(rows, levels)
            out.append(answers_to(rows, totals, places))
        return pd.concat(out)

    def pass_back(level: int) -> Callable:
        def run(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            out, told = [], told.sort_values(["k", "path"])
            for k, rows in frame.groupby("k", sort=True):
                totals = np.concatenate([_unpack(x, np.int64) for x in told["totals"][told["k"] == k]])
                out.append(answers_to(rows, totals, added(rows, level)[2]))
            return pd.concat(out)

        return run

    def look_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = _Block(left.iloc[0])
        right = right.sort_values(["k", "path"])

        def totals(k: int) -> np.ndarray:
            return np.concatenate([np.empty(0, np.int64), *(_unpack(x, np.int64) for x in right["totals"][right["k"] == k])])

        logs = block.scores(totals, order, words, alpha, min_count)
        mean = np.divide(logs, block.sizes, out=np.full(len(logs), np.nan), where=block.sizes > 0)
        doc_id = pd.Series(block.ids, dtype="Int64").mask(block.null)
        return pd.DataFrame({"doc_id": doc_id, "n_words": block.sizes, "log_score": logs, "mean_log_score": mean})

    schema = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "null", "sizes", "vocabulary", "places"))])
    blocks = rows.mapInArrow(gather, "block long, ids binary, null binary, sizes binary, vocabulary binary, places binary")
    request, answer = "node long, owner long, k int, path long, keys binary, counts binary", "owner long, k int, path long, totals binary"
    sent = [blocks.groupBy("block").applyInPandas(explode, request)]
    for level in range(1, levels):
        sent.append(sent[-1].groupBy("node").applyInPandas(pass_on(level), request))
    answers = sent.pop().groupBy("node").applyInPandas(add, answer)
    for level in range(levels - 1, 0, -1):
        answers = sent.pop().groupBy("node").cogroup(answers.groupBy("owner")).applyInPandas(pass_back(level), answer)
    scored = blocks.groupBy("block").cogroup(answers.groupBy("owner")).applyInPandas(look_up, "doc_id long, n_words long, log_score double, mean_log_score double")
    return scored.withColumn("mean_log_score", F.nanvl("mean_log_score", F.lit(None).cast("double")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
b AS (SELECT *, lag(w) OVER g AS w1, lag(w, 2) OVER g AS w2 FROM p WINDOW g AS (PARTITION BY doc_id ORDER BY i)),
f1 AS (SELECT w, count(*) AS n FROM b GROUP BY w),
f2 AS (SELECT w1, w, count(*) AS n FROM b WHERE w1 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT w2, w1, w, count(*) AS n FROM b WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
s AS (SELECT b.doc_id, CASE WHEN f3.n IS NOT NULL THEN ln(f3.n / c2.n)
      ELSE CASE WHEN b.w2 IS NOT NULL THEN ln({ALPHA}) ELSE 0 END + CASE WHEN f2.n >= {MIN_COUNT} THEN ln(f2.n / c1.n)
      ELSE CASE WHEN b.w1 IS NOT NULL THEN ln({ALPHA}) ELSE 0 END + ln(f1.n / (SELECT count(*) FROM p)) END END AS x
  FROM b JOIN f1 ON b.w = f1.w LEFT JOIN f1 c1 ON b.w1 = c1.w LEFT JOIN f2 ON b.w1 = f2.w1 AND b.w = f2.w
  LEFT JOIN f2 c2 ON b.w2 = c2.w1 AND b.w1 = c2.w LEFT JOIN f3 ON b.w2 = f3.w2 AND b.w1 = f3.w1 AND b.w = f3.w),
t AS (SELECT doc_id, sum(x) AS x, count(*) AS n FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n, 0)::BIGINT AS n_words, round(coalesce(t.x, 0), 4) AS log_score, round(t.x / t.n, 6) AS mean_log_score
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
