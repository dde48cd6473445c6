"""Vector code compression: product codes by float32 screening with rounding-error intervals, decided in 64-bit integers.

Components become integers floor(4096 x). A vector is cut into 8 consecutive parts of equal length; each part position
has a codebook of up to 16 integer entries, first those of the 16 smallest ids. Each of 6 rounds gives every part to its
nearest entry (squared Euclidean distance, ties to the lower index) and replaces every entry in use by the floor of its
parts' mean; then parts are assigned once more.

An assignment screens by one float32 matrix product per part position. What it can be wrong by is known: rounding the
two factors and d products and sums are d + 2 relative errors of at most 2^-24 each, so the product is within
gamma * |x| * |c|, gamma = (d + 2) u / (1 - (d + 2) u) (Cauchy-Schwarz bounds the sum of the terms' sizes). The interval
of |c|^2 - 2 x c gets that and the error of the doubles it is computed in. Entries whose interval overlaps the one with
the lowest upper end are computed anew in int64, and the least of them wins, the lower index among equals. An entry
left out is strictly farther than another one, so the result is exact.

The integers are written once to the shared checkpoint folder; a round is a pass over them that gives sums per task
(16 times the vector's length, at most), added up by key. Only a codebook (16 vectors) passes through the driver.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped, as are empty vectors. Shorter
vectors than the longest, and a length that 8 doesn't divide, are filled up with zeros. Components are held within
what 64-bit sums of squares can express (beyond about 32,000 for 64 components, before scaling). Fewer than 16 kept rows give
as many entries. Repeated ids are rows of their own; among equal ids the lesser vector comes first, a null id comes last.
Null labels count as equal. No rows give no rows. Other columns aren't read, so none can clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import table
from engram.session import Scratch

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Unit roundoff of float32 and of float64.
U32, U64 = 2.0**-24, 2.0**-53


def screened(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Which entries can be the nearest: (part, vector, entry). ``x``: (part, vector, place), ``books``: (part, entry, place)."""
    d = x.shape[2]
    dots = np.matmul(x.astype(np.float32), books.astype(np.float32).transpose(0, 2, 1)).astype(np.float64)
    squares = (books * books).sum(axis=2)[:, None, :].astype(np.float64)
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=2))[:, :, None] * np.sqrt(squares)
    gamma = (d + 2) * U32 / (1 - (d + 2) * U32)
    scores = squares - 2 * dots
    reach = (2 * gamma * lengths + 4 * U64 * (squares + 2 * np.abs(dots))) * (1 + 2**-20)  # the factor covers the rounding of these sums themselves
    return scores - reach <= (scores + reach).min(axis=2, keepdims=True)


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance, both (vector, part), exact."""
    x = vectors.reshape(len(vectors), PARTS, -1).transpose(1, 0, 2)
    open_ = screened(x, books)
    chosen = open_.argmax(axis=2)
    part, row = np.nonzero(open_.sum(axis=2) > 1)
    which, entry = np.nonzero(open_[part, row])
    gap = x[part[which], row[which]] - books[part[which], entry]
    order = np.lexsort((entry, (gap * gap).sum(axis=1), which))
    _, first = np.unique(which[order], return_index=True)
    chosen[part, row] = entry[order[first]]
    gap = x - books[np.arange(PARTS)[:, None], chosen]
    return chosen.T, (gap * gap).sum(axis=2).T


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("numbers").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _sums(books: np.ndarray) -> Callable:
    k, width = books.shape[1], books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((PARTS, k, width), dtype=np.int64), np.zeros((PARTS, k), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch)
            chosen, _ = nearest(vectors, books)
            parts = vectors.reshape(len(vectors), PARTS, -1)
            for p in range(PARTS):
                order = np.argsort(chosen[:, p], kind="stable")
                used, at = np.unique(chosen[order, p], return_index=True)
                totals[p, used] += np.add.reduceat(parts[order, p], at)
                counts[p] += np.bincount(chosen[:, p], minlength=k)
        used = np.argwhere(counts)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(used[:, 0], pa.int32()), "entry": pa.array(used[:, 1], pa.int32()),
            "n": pa.array(counts[counts > 0], pa.int64()), "sums": pa.array(list(totals[counts > 0]), pa.list_(pa.int64())),
        })

    return run


def _coder(books: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, errors = nearest(_vectors(batch), books)
            code = chosen.astype(np.uint8).tobytes().hex()
            codes = [code[at : at + 2 * PARTS] for at in range(0, len(code), 2 * PARTS)]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": pa.array(codes, pa.string()), "error": pa.array(errors.sum(axis=1), pa.int64())})

    return run


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, vector`` of the rows with a whole vector, scaled, not yet floored."""
    vector = F.col(vector_col).cast("array<double>")
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & (F.size(vector) > 0)
    return rows.filter(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.transform(vector, lambda x: x * SCALE).alias("vector"))


def _integers(rows: DataFrame) -> DataFrame:
    """``vec_id, label, numbers``: floored, of one length."""
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or PARTS
    dims = -(-longest // PARTS) * PARTS
    most = math.isqrt(2**62 // dims) // 2
    filled = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("vector")))
    numbers = F.transform(filled, lambda x: F.floor(F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), x))).cast("int"))
    return rows.select("vec_id", "label", numbers.alias("numbers"))


def _replaced(books: np.ndarray, sums: list) -> np.ndarray:
    """Entries in use become the floor of their parts' mean."""
    books = books.copy()
    for part, entry, at, n, total in sums:
        books[part, entry, at] = total // n
    return books


def learn(numbers: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, place) of the table of integers; None if it has no rows."""
    seeds = numbers.orderBy(F.col("vec_id").asc_nulls_last(), "numbers").limit(ENTRIES).select("numbers").collect()
    if not seeds:
        return None
    books = np.array([r[0] for r in seeds], dtype=np.int64).reshape(len(seeds), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = numbers.select("numbers").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        by_place = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "total")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = _replaced(books, by_place.collect())
    return books


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: ``vec_id, label, code, error, label_error, codebooks_sha256``."""
    scratch = Scratch(rows.sparkSession)
    numbers = scratch.keep(_integers(quantised(rows, id_col, vector_col, label_col)))
    books = learn(numbers, rounds)
    label = numbers.schema["label"].dataType.simpleString()
    coder = _coder(books if books is not None else np.zeros((PARTS, 1, 1), dtype=np.int64))
    coded = scratch.keep(numbers.mapInArrow(coder, f"vec_id long, label {label}, code string, error long"))
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    result = coded.join(errors, F.col("label").eqNullSafe(F.col("of"))).drop("of").withColumn("codebooks_sha256", F.lit(digest(books)))
    scratch.drop(numbers)
    return result


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, vector``: each code's entries, put together and scaled back. The codebooks are 16 vectors."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(x / SCALE) for x in entry]) for entry in part]) for part in books.tolist()])
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.select("vec_id", F.concat(*[entries[p][at(p)] for p in range(PARTS)]).alias("vector"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def _oracle() -> str:
    """The same rounds in SQL, one after the other, all in integers."""
    gap = "CAST(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    floored = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT)) AS q FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // {PARTS}) + 1 : (part + 1) * (len(q) // {PARTS})] AS v FROM kept, range({PARTS}) t(part))",
        f"b0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id))",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, part, entry, gap FROM (SELECT p.vec_id, p.part, b.entry, {gap} AS gap, row_number() OVER (PARTITION BY p.vec_id, p.part ORDER BY {gap}, b.entry) AS n "
            f"FROM p JOIN b{r} b ON p.part = b.part) WHERE n = 1)"
        )
        if r < ROUNDS:
            steps.append(
                f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT part, entry, list({floored} ORDER BY i) AS v FROM "
                f"(SELECT part, entry, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM a{r} JOIN p USING (vec_id, part)) GROUP BY part, entry, i) GROUP BY part, entry) m "
                "ON b.part = m.part AND b.entry = m.entry)"
            )
    return (
        f"WITH {', '.join(steps)}, c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(gap) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id), "
        f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN c USING (vec_id), h"
    )


ORACLE_SQL = _oracle()
