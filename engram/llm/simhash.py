"""SimHash near-dedup: 64-bit fingerprints of 3-word shingles, met by fuzzy Golay keys, linked at 3 or fewer differing bits.

A text's fingerprint has bit k set if over half of its shingles' hashes (XXH64 of the UTF-8, seed 42, repeats count) have
it. Two fingerprints that differ in at most 3 of 64 bits agree wholly in one of their four quarters (16 bits), and of
the two halves of the other 48 bits one has at most one error. A half's first 23 bits are decoded by the perfect binary
Golay code: the word's own codeword is at most 3 bits away, and a word with one bit changed is at most 4 away from it.
So a word has its own codeword as key and, where that is 3 away, five more at distance 4 as further keys: of two words
at distance 0 or 1, each has the own key of the other. A key is the pair of segments, the equal quarter and the 12-bit
index of a codeword: at most 48 for each fingerprint, eight of them its own, of 28 bits (one fingerprint in 268 million
has a key by chance).

1. Equal fingerprints are one vertex, so a group of copies of any size is one row from here on.
2. Keys with a single row, or that are nobody's own, go. A key's rows are compared by flooding: what has been reached
   isn't compared again, so a dense group takes about linear time and gives a tree of links, never a row per pair. Keys
   with more rows than ``side`` are dealt to cells of two blocks each, every two blocks meeting once.
3. Every link is verified on the whole fingerprints; components of the links follow.

Nothing is broadcast or collected, no partner is dropped: work on a key with many different fingerprints that don't
link grows with the square of their number over ``side`` tasks (exact, without a cap).

Defined cases: texts without words, empty and null ones have the fingerprint zero and link like any other. A text with
fewer than three words is one shingle. A very long text is read in pieces of a megabyte. Rows that repeat an id count as documents of their
own with that id. A null id takes part, but is nobody's ``component_id`` (null if no other is reachable). No rows give
no rows. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import id_and_text, packed, table
from engram.llm.components import connected_components
from engram.session import Scratch

WIDTH, SEED, MOST = 3, 42, 3
#: Rows of a block of a key with very many rows: a task holds two blocks (17 bytes a row).
SIDE = 20_000
#: Bytes of text whose words are held at once.
PIECE = 1 << 20
#: Groups up to this size are compared without a loop over their members.
SMALL = 8
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GENERATOR, LENGTH, CHECKS = 0b101011100011, 23, 11
_LANES = np.uint64(0x0101010101010101)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits; eight bits at a time, one to a byte, 255 hashes to a sum."""
    counts = np.zeros(64, dtype=np.int64)
    at = np.arange(0, len(hashes), 255)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, at)
        counts[bit::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, as slices of the joined words."""
    joined, n = b" ".join(words), len(words) - width + 1
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)


def fingerprint(text: str | None, piece: int = PIECE) -> int:
    """The 64-bit fingerprint of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    counts, total, start, words = np.zeros(64, dtype=np.int64), 0, 0, []
    while start < len(raw):
        gap = _SPACE.search(raw, min(start + piece, len(raw)))
        end = gap.start() if gap else len(raw)
        words += raw[start:end].split()
        start = end + 1
        if len(words) >= WIDTH:
            found = _hashes(words, WIDTH)
            counts, total, words = counts + bit_counts(found), total + len(found), words[1 - WIDTH :]
    if not total and words:
        counts, total = bit_counts(_hashes(words, len(words))), 1
    return sum(1 << k for k in np.flatnonzero(2 * counts > total).tolist())


class Golay:
    """Nearest codewords of 23-bit words. A codeword's index are its first 12 bits; the other 11 follow from them."""

    def __init__(self) -> None:
        self.rest = self._remainder(np.arange(1 << (LENGTH - CHECKS), dtype=np.int64) << CHECKS)
        bits = np.concatenate(([0], 1 << np.arange(LENGTH, dtype=np.int64)))
        errors = np.unique(bits[:, None, None] ^ bits[None, :, None] ^ bits)  # all of weight 3, 2, 1 and 0: one for each remainder
        self.error = np.zeros(1 << CHECKS, dtype=np.int64)
        self.error[self._remainder(errors)] = errors

    @staticmethod
    def _remainder(words: np.ndarray) -> np.ndarray:
        """Of the words as polynomials, divided by the generator."""
        words = words.copy()
        for bit in range(LENGTH - 1, CHECKS - 1, -1):
            words ^= ((words >> bit) & 1) * (GENERATOR << (bit - CHECKS))
        return words

    def index(self, words: np.ndarray) -> np.ndarray:
        """Index of the codeword nearest to each word."""
        remainder = self.rest[words >> CHECKS] ^ (words & ((1 << CHECKS) - 1))
        return (words ^ self.error[remainder]) >> CHECKS

    def near(self, words: np.ndarray) -> np.ndarray:
        """A row for each word: the nearest index, then those of all words one bit away."""
        flips = np.concatenate(([0], 1 << np.arange(LENGTH, dtype=np.int64)))
        return self.index(words[:, None] ^ flips)


def keys(prints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position of the fingerprint, key, and whether it is the fingerprint's own key."""
    at, found, own = [], [], []
    for quarter in range(4):
        low = np.uint64(16 * quarter)
        equal = ((prints >> low) & np.uint64(0xFFFF)).astype(np.int64)
        above = prints >> low >> np.uint64(16)
        rest = (prints & ((np.uint64(1) << low) - np.uint64(1))) | (above << low)
        for half in range(2):
            word = ((rest >> np.uint64(24 * half)) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
            near = golay.near(word)
            first = near[:, 0].copy()
            near.sort(axis=1)
            new = np.ones(near.shape, dtype=bool)
            new[:, 1:] = near[:, 1:] != near[:, :-1]
            row, column = np.nonzero(new)
            index = near[row, column]
            at.append(row)
            found.append(((2 * quarter + half) << 28) | (equal[row] << 12) | index)
            own.append(index == first[row])
    return np.concatenate(at), np.concatenate(found), np.concatenate(own)


def _describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        prints = np.fromiter((fingerprint(t) for t in frame["text"]), dtype=np.uint64, count=len(frame))
        yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "print": prints.view(np.int64)})


def _keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    golay = Golay()
    for frame in frames:
        for start in range(0, len(frame), 5_000):
            prints = frame["print"].to_numpy()[start : start + 5_000]
            at, found, own = keys(prints.view(np.uint64), golay)
            yield pd.DataFrame({"key": found, "print": prints[at], "own": own})


def _flood(prints: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A tree of links for each set of connected members: a member, and those that it reaches first."""
    waiting = np.arange(len(prints))
    while len(waiting):
        reached, waiting = [waiting[0]], waiting[1:]
        while reached and len(waiting):
            now = reached.pop()
            near = np.bitwise_count(prints[waiting] ^ prints[now]) <= MOST
            if not own[now]:
                near &= own[waiting]
            if near.any():
                hit, waiting = waiting[near], waiting[~near]
                reached.extend(hit.tolist())
                yield now, hit


def _links_of(cells: np.ndarray, prints: np.ndarray, own: np.ndarray) -> pd.DataFrame:
    """Links within whole cells; rows come sorted by cell."""
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.append(starts, len(cells)))
    small = np.repeat(sizes <= SMALL, sizes)
    a, b = [], []
    for step in range(1, min(SMALL, len(cells))):
        meets = (cells[step:] == cells[:-step]) & small[step:] & (own[step:] | own[:-step])
        left = np.flatnonzero(meets)
        near = left[np.bitwise_count(prints[left] ^ prints[left + step]) <= MOST]
        a.append(prints[near])
        b.append(prints[near + step])
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        part = prints[start : start + size]
        for now, hit in _flood(part, own[start : start + size]):
            a.append(np.full(len(hit), part[now]))
            b.append(part[hit])
    a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.uint64) for x in (a, b))
    a, b = a.view(np.int64), b.view(np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).query("a != b").drop_duplicates()


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut at the ends of cells; the last cell of a batch waits for the rest of it."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = frame["cell"].to_numpy() == frame["cell"].iloc[-1]
        if kept and kept[-1]["cell"].iloc[-1] == frame["cell"].iloc[-1] and last.all():
            kept.append(frame)
            continue
        whole = pd.concat([*kept, frame[~last]])
        kept = [frame[last]]
        if kept[0]["cell"].iloc[0] == (whole["cell"].iloc[-1] if len(whole) else None):
            whole, kept = whole[whole["cell"] != kept[0]["cell"].iloc[0]], [whole[whole["cell"] == kept[0]["cell"].iloc[0]], *kept]
        if len(whole):
            yield _links_of(whole["cell"].to_numpy(), whole["print"].to_numpy().view(np.uint64), whole["own"].to_numpy(dtype=bool))
    if kept:
        whole = pd.concat(kept)
        yield _links_of(whole["cell"].to_numpy(), whole["print"].to_numpy().view(np.uint64), whole["own"].to_numpy(dtype=bool))


def links(prints: DataFrame, side: int = SIDE) -> DataFrame:
    """``a, b``: enough verified links between the distinct fingerprints of ``prints`` (print) to connect all that link."""
    rows = prints.mapInPandas(_keyed, "key long, print long, own boolean")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("owned")).filter("n > 1 AND owned")
    met = rows.join(shared.select("key", F.ceil(F.col("n") / side).cast("int").alias("blocks")).hint("merge"), "key")
    block = F.pmod(F.xxhash64("print"), "blocks").cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: (i != block) | (F.col("blocks") == 1))
    cell = F.xxhash64("key", F.least(block, F.col("other")), F.greatest(block, F.col("other")))
    dealt = met.withColumn("other", F.explode(others)).select(cell.alias("cell"), "print", "own")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInPandas(_compare, "a long, b long").distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side: int = SIDE) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id, kept``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    described = scratch.keep(id_and_text(docs, id_col, text_col).mapInPandas(_describe, "doc_id long, print long"))
    firsts = scratch.keep(described.groupBy("print").agg(F.min("doc_id").alias("first")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = scratch.keep(links(firsts.select("print").repartition(parts, "print"), side))
    found = connected_components(near, scratch=scratch)
    labelled = firsts.join(found.withColumnRenamed("vertex", "print"), "print", "left").select("print", "first", F.coalesce("component", "print").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = labelled.join(least, "component").select("print", "component_id")
    named = F.lpad(F.lower(F.hex("print")), 16, "0")
    joined = described.join(classes, "print").select("doc_id", named.alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    result = scratch.keep(joined)
    scratch.drop_all_but(result)
    return result


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its component's, with all their columns."""
    kept = components(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(packed(docs).alias("row"), F.col(id_col).cast("long").alias("own_id"))
    return rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
