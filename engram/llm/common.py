"""What several operators share: input columns under fixed names, tokenising, hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts write it.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the whole text (null as empty), so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def packed(docs: DataFrame) -> Column:
    """The whole row as one struct: names of its columns can't clash with an operator's own."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns])


def in_blocks(batch: pa.RecordBatch, most: int, size: Callable[[int], int] = int) -> Iterator[pa.RecordBatch]:
    """The batch in slices, not copies, each closed by the row at which ``size`` of the code points of its ``text`` adds up to ``most``.

    A batch may be all of a task's texts, so only a slice of it becomes Python objects at once.
    """
    start = total = 0
    for k, length in enumerate(pc.utf8_length(batch.column("text")).to_pylist()):
        total += size(length)
        if total >= most:
            yield batch.slice(start, k + 1 - start)
            start, total = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which a Python worker returns to the system what it has freed.

    Workers outlive their tasks: what one keeps counts for its executor in every later stage, also in those without Python.
    """

    @wraps(run)
    def to_the_end(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return to_the_end


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, remembered up to ``most`` words (a memory bound, never a limit on words)."""

    def __init__(self, seed: int = 0, most: int = 200_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes, in order."""
    n = len(hashes) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = mixed(total + hashes[k : k + n] + np.uint64(k + 1))
    return total
