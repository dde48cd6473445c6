"""Vectors: normalising, hashed embedding, exact top-k of a stated query set by blocks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from engram.functions.text import fold
from engram.operators import nearest

WORD_WEIGHT, GRAM_WEIGHT, GRAM = 1.0, 0.35, 4
#: Vectors that a task holds at once.
AT_ONCE = 64
_TOKEN = re.compile(r"\w+")


def l2(vector: Column) -> Column:
    """Vector of length 1; a zero vector stays."""
    numbers = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, numbers).otherwise(F.transform(numbers, lambda x: x / norm))


def cosine(a: Column, b: Column) -> Column:
    """Of vectors of length 1."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def embed_text(text: str | None, dim: int, buckets: dict[str, tuple[int, float]]) -> np.ndarray:
    """Words and character 4-grams hashed to signed buckets; the empty text is the first unit vector."""
    words = _TOKEN.findall(fold(text or ""))
    padded = f" {' '.join(words)} "
    vector = np.zeros(dim)

    def add(token: str, weight: float) -> None:
        known = buckets.get(token)
        if known is None:
            value = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
            if len(buckets) > 200_000:
                buckets.clear()
            known = buckets[token] = (value % dim, 1.0 if value >> 63 else -1.0)
        vector[known[0]] += known[1] * weight

    for word in words:
        add(f"w:{word}", WORD_WEIGHT)
    for at in range(max(0, len(padded) - GRAM + 1)):
        add(f"g:{padded[at : at + GRAM]}", GRAM_WEIGHT)
    norm = np.linalg.norm(vector)
    if norm == 0:
        vector[0], norm = 1.0, 1.0
    return vector / norm


def embedder(dim: int = 1024):
    """Vectorised UDF text -> vector."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets: dict[str, tuple[int, float]] = {}
        for texts in batches:  # vectors leave in small pieces, whatever the size of a batch
            for at in range(0, len(texts), AT_ONCE):
                yield pd.Series([embed_text(t, dim, buckets).astype(np.float32) for t in texts.iloc[at : at + AT_ONCE]], dtype=object)

    return embed


def top_k(queries: DataFrame, corpus: DataFrame, k: int, block: int = nearest.BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str | None = None) -> DataFrame:
    """``query_id, vec_id, similarity, place``: the k nearest of all rows (or of its group's) for each query, exact, ties by id."""
    group = F.lit("") if group_col is None else F.col(group_col)
    rows = lambda df: df.select(F.col(id_col).alias("id"), group.alias("group"), F.col(vector_col).alias("payload"))
    found = nearest.top_k(rows(queries), rows(corpus), k, block_rows=block, part_queries=4 * block)
    return found.withColumnRenamed("score", "similarity")
