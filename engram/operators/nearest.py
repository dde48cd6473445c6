"""Top-k of a stated query set by blocks, and an inverted file for approximate nearest neighbours.

``top_k`` deals the rows of each group to blocks and the group's queries to parts; each part meets each block in one
task, which keeps only its k best rows for a query. So no row per (query, row) pair leaves a task, no group has to fit
into one, and nothing goes through the driver. The work is exact and grows with queries times rows, as it must.

``IvfIndex`` is for when that is too much: k-means cells as folders, a query looks into its nearest cells only, by the
same exact ``top_k`` with the cell as group. All rows are indexed; the cells' centres are learnt from a bounded sample.
How many cells a query looks into is measured when the index is built: for a bounded sample of rows the exact nearest
are found, and the number is such that ``TARGET`` of them lie in that many nearest cells. On vectors that fall into
clusters that is a few; on vectors spread evenly in many dimensions no index of this kind can skip much, and this one
then says so by a high number instead of losing neighbours.

Defined cases: rows and queries with a null group, vector or id are left out (an equality join would, too). Ties go to the smaller id. Rows
that repeat an id are rows of their own. Vectors are of one length; a vector of zeros has similarity 0 to everything. No
rows or no queries give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block, queries of a part, and queries that are scored at once.
BLOCK_ROWS, PART_QUERIES, AT_ONCE = 4096, 16_384, 256
#: Numbers in the payloads of a block, on average: long rows come in blocks of fewer rows.
BLOCK_NUMBERS = 1 << 19
#: Rows that centres are learnt from, for each cell.
SAMPLE_PER_CELL = 256
#: Rows that the number of probed cells is measured on, how many nearest of each, and the share of them to be found.
TRIAL_ROWS, TRIAL_NEAREST, TARGET = 256, 10, 0.95

#: Given a block's payloads: a function from some queries' payloads to one array of scores per query (-inf: no match).
Scorer = Callable[[list], Callable[[list], Iterator[np.ndarray]]]


def by_cosine(vectors: list) -> Callable[[list], Iterator[np.ndarray]]:
    """Cosine of the vectors, to 6 decimals."""

    def unit(rows: list) -> np.ndarray:
        made = np.array([np.asarray(x, dtype=np.float64) for x in rows])
        return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-300)

    block = unit(vectors).T
    return lambda asked: iter(np.round(unit(asked) @ block, 6))


def by_occurrences(texts: list) -> Callable[[list], Iterator[np.ndarray]]:
    """How often any of a query's terms occurs in each row; terms are 64-bit hashes."""
    many = len(texts)
    said = np.concatenate([np.asarray(x, dtype=np.int64) for x in texts])
    row = np.repeat(np.arange(many, dtype=np.int32), [len(x) for x in texts])
    order = np.argsort(said, kind="stable")
    said, row = said[order], row[order]
    del order, texts

    def score(asked: list) -> Iterator[np.ndarray]:
        for terms in asked:
            low, high = np.searchsorted(said, terms, "left"), np.searchsorted(said, terms, "right")
            hits = np.concatenate([row[a:b] for a, b in zip(low, high, strict=True)]) if len(terms) else row[:0]
            found = np.bincount(hits, minlength=many).astype(np.float64)
            found[found == 0] = -np.inf
            yield found

    return score


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, then smaller id."""
    some = np.flatnonzero(scores > -np.inf)
    if len(some) > k:
        some = some[scores[some] >= np.partition(scores[some], -k)[-k]]
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _meeting(scorer: Scorer, k: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, rows, score = None, [], [], None
        for frame in frames:
            spot = list(zip(frame["group"], frame["block"], frame["part"], strict=True))
            asks = frame["asks"].to_numpy(dtype=bool)
            turns = [0, *(i for i in range(1, len(frame)) if spot[i] != spot[i - 1] or asks[i] != asks[i - 1]), len(frame)]
            for a, b in zip(turns, turns[1:], strict=False):
                if a == b:
                    continue
                if spot[a] != now:
                    now, ids, rows, score = spot[a], [], [], None
                some = frame["payload"].iloc[a:b].tolist()
                if not asks[a]:
                    ids.append(frame["id"].to_numpy(dtype=np.int64)[a:b])
                    rows += some
                    continue
                if score is None:
                    if not rows:
                        continue
                    names, score = np.concatenate(ids), scorer(rows)
                    ids, rows = [], []  # the scorer has what it needs
                queries = frame["id"].to_numpy(dtype=np.int64)[a:b]
                for start in range(0, len(some), AT_ONCE):
                    out = []
                    for query, scores in zip(queries[start : start + AT_ONCE], score(some[start : start + AT_ONCE]), strict=True):
                        best = _best(scores, names, k)
                        out.append((np.full(len(best), query), names[best], scores[best]))
                    q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    return run


def top_k(queries: DataFrame, corpus: DataFrame, k: int, scorer: Scorer = by_cosine, block_rows: int = BLOCK_ROWS, part_queries: int = PART_QUERIES) -> DataFrame:
    """``query_id, vec_id, score, place``: the k best rows of its own group for each query, exact, ties by id.

    ``queries`` and ``corpus`` have ``id, group, payload``.
    """
    fine = F.col("id").isNotNull() & F.col("group").isNotNull() & F.col("payload").isNotNull()
    queries, corpus = (df.select(F.col("id").cast("long").alias("id"), F.col("group").cast("string").alias("group"), "payload").filter(fine) for df in (queries, corpus))
    number = lambda df, *sizes, name: df.groupBy("group").agg(F.greatest(*(F.ceil(n / size) for n, size in sizes)).cast("int").alias(name))
    rows, numbers = F.count(F.lit(1)), F.sum(F.size("payload"))
    blocks, parts = number(corpus, (rows, block_rows), (numbers, BLOCK_NUMBERS), name="blocks"), number(queries, (rows, part_queries), (numbers, 4 * BLOCK_NUMBERS), name="parts")
    sizes = blocks.join(parts, "group")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id", "payload"), F.col(n)).cast("int")
    hosts = corpus.join(sizes, "group").select("group", dealt("blocks").alias("block"), upto("parts").alias("part"), F.lit(False).alias("asks"), "id", "payload")
    guests = queries.join(sizes, "group").select("group", upto("blocks").alias("block"), dealt("parts").alias("part"), F.lit(True).alias("asks"), "id", "payload")
    told = hosts.union(guests).repartition("group", "block", "part").sortWithinPartitions("group", "block", "part", "asks")
    found = told.mapInPandas(_meeting(scorer, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= k)


class IvfIndex:
    """Rows ``id, payload`` in folders of their nearest centre's cell, and the centres."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, rows: DataFrame, cells: int | None = None, seed: int = 7) -> None:
        """Write the index of ``rows`` (id, payload: vector) anew. By default there are as many cells as the root of the number of rows."""
        rows = rows.filter("id IS NOT NULL AND payload IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("payload").cast("array<double>").alias("payload"))
        total = rows.count()
        cells = max(1, min(cells or round(math.sqrt(total)), total))
        norm = F.sqrt(F.aggregate("payload", F.lit(0.0), lambda a, x: a + x * x))
        unit = rows.withColumn("unit", array_to_vector(F.when(norm > 0, F.transform("payload", lambda x: x / norm)).otherwise(F.col("payload"))))
        if cells > 1:
            share = min(1.0, SAMPLE_PER_CELL * cells / total)
            by_hash = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
            model = KMeans(k=cells, seed=seed, featuresCol="unit", predictionCol="cell", maxIter=10, initSteps=2).fit(unit.filter(by_hash).select("unit"))
            placed, centres = model.transform(unit), [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())]
        else:
            placed, centres = unit.withColumn("cell", F.lit(0)), [(0, rows.first()["payload"])] if total else []
        placed.select("id", "payload", "cell").repartition("cell").write.partitionBy("cell").mode("overwrite").parquet(f"{self.path}/cells")
        self.spark.createDataFrame(centres, "id long, payload array<double>").write.mode("overwrite").parquet(f"{self.path}/centres")
        self.spark.createDataFrame([(self._needed(cells, seed),)], "probes int").write.mode("overwrite").parquet(f"{self.path}/about")

    def _needed(self, cells: int, seed: int) -> int:
        """Nearest cells that hold ``TARGET`` of the nearest rows of a sample, the row itself left out."""
        rows, one = self.rows(), lambda df: df.withColumn("group", F.lit("0"))
        trial = rows.select("id", "payload").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(TRIAL_ROWS)
        near = top_k(one(trial), one(rows), TRIAL_NEAREST + 1).filter("query_id <> vec_id").select("query_id", F.col("vec_id").alias("id"))
        homes = near.join(rows.select("id", "cell"), "id")
        order = top_k(one(trial), one(self.centres()), cells).select("query_id", F.col("vec_id").cast("int").alias("cell"), "place")
        place = homes.join(order, ["query_id", "cell"]).agg(F.percentile("place", F.lit(TARGET))).first()[0]
        return math.ceil(place or 1)

    def centres(self) -> DataFrame:
        return self.spark.read.schema("id long, payload array<double>").parquet(f"{self.path}/centres")

    def rows(self) -> DataFrame:
        return self.spark.read.schema("id long, payload array<double>, cell int").parquet(f"{self.path}/cells")

    def probes(self) -> int:
        """Cells that a query looks into by default."""
        return self.spark.read.schema("probes int").parquet(f"{self.path}/about").first()[0]

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """``query_id, vec_id, score, place``: the k best among the rows of each query's ``probes`` nearest cells."""
        probes = probes or self.probes()
        queries = queries.select(F.col("id").cast("long").alias("id"), F.col("payload").cast("array<double>").alias("payload")).filter("id IS NOT NULL AND payload IS NOT NULL")
        one = lambda df: df.withColumn("group", F.lit("0"))
        near = top_k(one(queries), one(self.centres()), probes).select(F.col("query_id").alias("id"), F.col("vec_id").cast("string").alias("group")).distinct()
        found = top_k(queries.join(near, "id"), self.rows().withColumnRenamed("cell", "group"), k)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= k)
