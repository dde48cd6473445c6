"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document's set are the hashes of its distinct five-word shingles (A-Z lower-cased; fewer words: the whole sequence as
one; no words: empty, linked with nothing). One permutation deals the set into bins of which each keeps its smallest
hash; an empty bin takes the value of the first full bin in its own fixed random sequence (densification), so each bin
agrees with the probability of the similarity. ``BANDS`` bands of ``ROWS`` bins are bucket keys: a pair of similarity
0.75 shares no bucket with probability (1 - 0.75^4)^32, about 5e-6.

1. Equal sets are one class, represented by its smallest id, so a group of copies of any size is one candidate.
2. A bucket's smallest representative is its centre; every other member is a candidate pair with it: as many pairs as
   members, never all pairs of a group. Pairs are confirmed on the full sets, recomputed from the whole texts.
3. Confirmed links and copies give components. A star leaves untested only pairs with a member that its centre refused
   and whose component is still another one. These doubtful members and those who share a bucket with them are searched
   exactly (``_rest``): a pair of the similarity must share one of the rarest few shingles of either set, so the doubtful
   ones are compared in blocks with all that share such a shingle. No cap, no lost link, and no row per pair. In a dense
   group of n members that hang together loosely, with d doubtful ones, this is d x n comparisons, over d x n /
   (BLOCK_SHINGLES x VISIT_SHINGLES) tasks in units of shingles.

Where both sides of a join grow with the input, the plan says merge join, so it is the same at every size and nothing of
that kind is broadcast. A centre meets its members in salted parts, so no task reads all members of one centre. Links and components stay in
tables of the shared checkpoint folder, each deleted when its successor is written; the result's own table stays.

Sets are of 64-bit hashes: two different shingles of one comparison agree with probability 2^-64 each, so even among
10^15 pairs of shingles that are compared about one in 20,000 runs would count a shingle too many.

Defined cases: null and empty texts have an empty set. A very long text is one row of any size: its set is made in one
task (8 bytes a shingle), and in the exact search it is a block of its own. Rows that repeat an id are one vertex: it is linked if one of
them is, ``n_shingles`` is each row's own. A null id is linked with nothing; its component is null and it is kept.
No rows give no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import WordHashes, id_and_text, in_blocks, lean, mixed, packed, table, windows, words_of
from engram.llm.components import connected_components
from engram.session import Scratch

WIDTH, PERCENT = 5, 75
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Shingles that a block of the exact search holds in memory (some 40 bytes each), and that a task streams past it.
BLOCK_SHINGLES, VISIT_SHINGLES = 1_000_000, 4_000_000
#: Code points of texts that become Python objects at once when sets are described.
BLOCK_CHARS = 1_000_000
#: Members that meet one copy of their centre's text.
SALT_MEMBERS = 1024
_EDGES = (np.arange(BINS, dtype=object) * 2**64 // BINS).astype(np.uint64)


def shingles(text: str | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(windows(hashes.of(words), min(width, len(words))) if len(words) >= width else windows(hashes.of(words), len(words)) ^ np.uint64(len(words)))


class _Probes:
    """Fixed random sequence of bins for each bin, drawn as far as it is needed."""

    def __init__(self) -> None:
        self.drawn = np.empty((BINS, 0), dtype=np.int64)

    def upto(self, n: int) -> np.ndarray:
        if self.drawn.shape[1] < n:
            step = np.arange(n, dtype=np.uint64)
            seed = np.arange(BINS, dtype=np.uint64)[:, None] << np.uint64(32)
            self.drawn = (mixed(seed + step + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)
        return self.drawn


def signature(found: np.ndarray, probes: _Probes) -> np.ndarray:
    """Densified one-permutation MinHash of a non-empty sorted set: a value per bin."""
    at = np.searchsorted(found, _EDGES)
    full = at < np.append(at[1:], len(found))
    values = np.zeros(BINS, dtype=np.uint64)
    values[full] = found[at[full]]
    if full.all():
        return values
    if full.sum() == 1:
        return np.full(BINS, found[0])
    empty, n = np.flatnonzero(~full), 16
    while len(empty):
        tries = full[probes.upto(n)[empty, :n]]
        hit = tries.any(axis=1)
        values[empty[hit]] = values[probes.drawn[empty[hit], tries[hit].argmax(axis=1)]]
        empty, n = empty[~hit], n * 4
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key per band."""
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in values.reshape(BANDS, ROWS).T:
        total = mixed(total + row)
    return total.view(np.int64)


def _describer(bucket_keys: Callable[[np.ndarray, _Probes], np.ndarray]) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, probes = WordHashes(), _Probes()
        for block in (block for batch in batches for block in in_blocks(batch, BLOCK_CHARS)):
            sizes, digests, keys = [], [], []
            for text in block.column("text").to_pylist():
                found = shingles(text, hashes)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                keys.append(bucket_keys(found, probes) if len(found) else np.empty(0, dtype=np.int64))
            columns = [block.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_hash", "bands"])

    return run


def minhash_keys(found: np.ndarray, probes: _Probes) -> np.ndarray:
    return bands(signature(found, probes))


@lean
def _confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose full sets are similar enough. Rows of one centre come together, so its set is made once."""
    hashes, last, centre = WordHashes(), None, None
    for frame in frames:
        fine = np.zeros(len(frame), dtype=bool)
        for k, (a, text_a, text_b) in enumerate(zip(frame["a"], frame["text_a"], frame["text_b"], strict=True)):
            if last != (a, text_a):
                last, centre = (a, text_a), shingles(text_a, hashes)
            other = shingles(text_b, hashes)
            small, large = sorted((len(centre), len(other)))
            if 100 * small >= PERCENT * large > 0:
                both = len(np.intersect1d(centre, other, assume_unique=True))
                fine[k] = 100 * both >= PERCENT * (len(centre) + len(other) - both)
        yield frame.loc[fine, ["a", "b"]]


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are alike; the text of a centre with many members goes to as many parts of them."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_MEMBERS).cast("int").alias("parts"))
    centres = texts.join(parts, texts["doc_id"] == parts["a"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", F.col("text").alias("text_a"))
    salted = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    right = salted.hint("merge").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.hint("merge").join(centres, ["a", "part"]).select("a", "b", "text_a", "text_b")
    return both.mapInPandas(_confirm, "a long, b long").distinct()


def _stars(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a: centre, b: member) of the buckets in ``rows`` (key, vertex), and whether one had more than two."""
    centres = rows.groupBy("key").agg(F.min("vertex").alias("a"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = rows.join(centres.hint("merge"), "key").filter(F.col("a") != F.col("vertex"))
    return met.groupBy("a", F.col("vertex").alias("b")).agg(F.max(F.col("size") > 2).alias("crowd"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends aren't in one component yet."""
    for end in ("a", "b"):
        label = found.select(F.col("vertex").alias(end), F.col("component").alias(f"{end}_in"))
        pairs = pairs.join(label, end, "left")
    return pairs.filter(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).drop("a_in", "b_in")


@lean
def _explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for frame in frames:
        for vertex, doubtful, text in zip(frame["vertex"], frame["doubtful"], frame["text"], strict=True):
            found = shingles(text, hashes).view(np.int64)
            yield pd.DataFrame({"vertex": vertex, "doubtful": doubtful, "n": len(found), "shingle": found})


def _rare_groups(texts: DataFrame) -> DataFrame:
    """``key, vertex, doubtful``: groups of the vertices that have a rare shingle of a doubtful one among their rarest.

    With shingles in one global order, two sets of n and m with a similarity of 0.75 share one of their first
    n - ceil(0.75 n) + 1 (and m likewise). The order is: shingles of one vertex or of no doubtful one, then by how many
    vertices have them, so passages that very many share come last and make no groups.
    """
    every = texts.select(F.col("doc_id").alias("vertex"), "doubtful", "text").mapInPandas(_explode, "vertex long, doubtful boolean, n long, shingle long")
    useful = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.max("doubtful").alias("some")).filter("times > 1 AND some").select("shingle", "times")
    shared = every.join(useful, "shingle")
    own = Window.partitionBy("vertex")
    ranked = shared.withColumn("nth", F.row_number().over(own.orderBy("times", "shingle"))).withColumn("useless", F.col("n") - F.count(F.lit(1)).over(own))
    first = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - F.col("useless")
    return ranked.filter(F.col("nth") <= first).select(F.col("shingle").alias("key"), "vertex", "doubtful", "n").distinct()


@lean
def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between the members of a block and its visitors. Rows come sorted by block, part and role, members first.

    A link whose ends are in one component by the links before it is left out, so a dense group gives a tree of links.
    """
    hashes, now = WordHashes(), None
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    ids, sets, index = [], [], None
    for frame in frames:
        out = []
        for block, part, visits, vertex, text in frame[["block", "part", "visits", "vertex", "text"]].itertuples(index=False):
            if now != (block, part):
                now, ids, sets, index = (block, part), [], [], None
                parent.clear()
            found = shingles(text, hashes)
            if not visits:
                ids.append(vertex)
                sets.append(found)
                continue
            if index is None:
                sizes = np.array([len(x) for x in sets])
                every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(every, kind="stable")
                index = every[order], owner[order], sizes, np.array(ids)
            every, owner, sizes, names = index
            low, high = np.searchsorted(every, found, "left"), np.searchsorted(every, found, "right")
            hits = np.repeat(low - np.concatenate(([0], np.cumsum(high - low)[:-1])), high - low) + np.arange((high - low).sum())
            both = np.bincount(owner[hits], minlength=len(sizes))
            near = names[(100 * both >= PERCENT * (sizes + len(found) - both)) & (names != vertex)]
            for x in near.tolist():
                if (one := root(vertex)) != (other := root(x)):
                    parent[max(one, other)] = min(one, other)
                    out.append((min(vertex, x), max(vertex, x)))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _rest(pairs: DataFrame, links: DataFrame, found: DataFrame, texts: DataFrame, scratch: Scratch, block_shingles: int, visit_shingles: int) -> DataFrame | None:
    """Links that no star has tested; None if every bucket was tested whole.

    Doubtful members are a stated query set, compared in blocks with all that share one of their rare shingles: a block
    holds about ``block_shingles`` shingles of them (or one longer text), and a task streams about ``visit_shingles``
    past it. Only links come out, so there is no row per pair.
    """
    refused = pairs.filter("crowd").select("a", "b").join(links, ["a", "b"], "left_anti")
    doubtful = scratch.keep(_apart(refused, found).select(F.col("b").alias("vertex")).distinct())
    if doubtful.isEmpty():
        return None
    crowds = pairs.filter("crowd").select("a", "b")
    centres = crowds.join(doubtful.withColumnRenamed("vertex", "b"), "b").select("a").union(doubtful).distinct()
    members = crowds.join(centres, "a").select(F.col("b").alias("vertex")).union(centres).distinct()  # share a bucket with a doubtful one
    near = members.join(doubtful.withColumn("doubtful", F.lit(True)), "vertex", "left")
    near = near.select("vertex", F.coalesce("doubtful", F.lit(False)).alias("doubtful"))
    texts = scratch.keep(texts.join(near, texts["doc_id"] == near["vertex"]).select("doc_id", "text", "doubtful"))
    groups = scratch.keep(_split_groups(_rare_groups(texts), found))
    if groups.isEmpty():
        return None
    sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    homes = groups.filter("doubtful").join(sizes, "key").groupBy("vertex").agg(F.max(F.struct("size", "key")).alias("home"), F.first("n").alias("n")).select("vertex", "n", "home.key")
    parts = homes.groupBy("key").agg(F.ceil(F.sum("n") / block_shingles).alias("parts"))
    blocks = scratch.keep(homes.join(parts, "key").select("vertex", F.xxhash64("key", F.pmod(F.xxhash64("vertex"), "parts")).alias("block")))
    calls = groups.filter("doubtful").join(blocks, "vertex").select("key", "block").distinct()
    visits = scratch.keep(groups.join(calls, "key").select("vertex", "n", "block").distinct())
    shares = visits.groupBy("block").agg(F.ceil(F.sum("n") / visit_shingles).cast("int").alias("shares"))
    hosts = blocks.join(shares, "block").select("vertex", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("part"), F.lit(False).alias("visits"))
    guests = visits.join(shares, "block").select("vertex", "block", F.pmod(F.hash("vertex"), "shares").alias("part"), F.lit(True).alias("visits"))
    told = hosts.union(guests).join(texts.select(F.col("doc_id").alias("vertex"), "text"), "vertex")
    return scratch.keep(told.repartition("block", "part").sortWithinPartitions("block", "part", "visits").mapInPandas(_compare, "a long, b long").distinct())


def _split_groups(groups: DataFrame, found: DataFrame) -> DataFrame:
    """The groups that still have a doubtful member and members of more than one component."""
    label = groups.join(found, "vertex", "left").select("key", F.coalesce("component", "vertex").alias("in"), "doubtful")
    open_keys = label.groupBy("key").agg(F.min("in").alias("low"), F.max("in").alias("high"), F.max("doubtful").alias("some")).filter("low < high AND some").select("key")
    return groups.join(open_keys, "key")


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: Callable[[np.ndarray, _Probes], np.ndarray] = minhash_keys) -> DataFrame:
    """``doc_id, n_shingles, set_hash, bands`` of every row."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_describer(bucket_keys), "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: Callable[[np.ndarray, _Probes], np.ndarray] = minhash_keys,
    block_shingles: int = BLOCK_SHINGLES, visit_shingles: int = VISIT_SHINGLES,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``."""
    scratch = Scratch(docs.sparkSession)
    described = scratch.keep(describe(docs, id_col, text_col, bucket_keys))
    sets = described.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    rows = sets.groupBy("set_hash").agg(F.min("doc_id").alias("vertex"), F.first("bands").alias("bands")).select("vertex", F.explode("bands").alias("key"))
    pairs = scratch.keep(_stars(rows))
    ends = pairs.select(F.col("a").alias("end")).union(pairs.select("b")).distinct()
    texts = id_and_text(docs, id_col, text_col)
    texts = scratch.keep(texts.join(ends.hint("merge"), texts["doc_id"] == ends["end"], "left_semi"))  # all that is compared from here on
    links = scratch.keep(_confirmed(pairs.select("a", "b"), texts))
    classes = sets.groupBy("set_hash").agg(F.min("doc_id").alias("vertex"), F.max("doc_id").alias("last")).filter("vertex < last").select("set_hash", "vertex")
    edges = scratch.keep(links.union(sets.join(classes, "set_hash").filter("doc_id <> vertex").select("doc_id", "vertex")))
    found = connected_components(edges, scratch=scratch)
    rest = _rest(pairs, links, found, texts, scratch, block_shingles, visit_shingles)
    if rest is not None:
        found = connected_components(edges.union(rest), known=found, scratch=scratch)
    joined = described.select("doc_id", "n_shingles").join(found.withColumnRenamed("vertex", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    result = scratch.keep(joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))
    scratch.drop_all_but(result)
    return result


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its component's, with all their columns."""
    kept = components(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(packed(docs).alias("row"), F.col(id_col).cast("long").alias("own_id"))
    return rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


#: Exact all-pairs join on shared shingles; quadratic in groups of copies, so for small tables only.
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {WIDTH} THEN list_transform(range(1, len(ws) - {WIDTH - 2}), lambda i: array_to_string(ws[i:i + {WIDTH - 1}], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN c cx ON p.x = cx.doc_id JOIN c cy ON p.y = cy.doc_id WHERE 100 * k >= {PERCENT} * (cx.n + cy.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON d.doc_id = m.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""
