"""How turns arrive: session and tumbling windows, the same expressions over tables and over streams.

These are operational figures (how busy a subject is, how long a session lasts), so on a stream a watermark may close
them: what comes later than ``late`` behind the latest arrival isn't counted any more. Facts and their validity never
depend on it (see ``typed_state`` and ``ingest``). Rows without a key or a time are in no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(rows: DataFrame, key: str, at: str, late: str | None) -> DataFrame:
    rows = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, late) if late else rows


def sessions(rows: DataFrame, key: str = "subject_id", at: str = "occurred_at", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """``<key>, started, ended, arrivals``: a session goes on while less than ``gap`` passes; it ends a gap after its last arrival."""
    met = _timed(rows, key, at, late).groupBy(key, F.session_window(at, gap).alias("window")).agg(F.count(F.lit(1)).alias("arrivals"))
    return met.select(key, F.col("window.start").alias("started"), F.col("window.end").alias("ended"), "arrivals")


def tumbling(rows: DataFrame, key: str = "role", at: str = "occurred_at", size: str = "1 hour", late: str | None = None) -> DataFrame:
    """``<key>, started, ended, arrivals`` per window of a fixed size."""
    met = _timed(rows, key, at, late).groupBy(key, F.window(at, size).alias("window")).agg(F.count(F.lit(1)).alias("arrivals"))
    return met.select(key, F.col("window.start").alias("started"), F.col("window.end").alias("ended"), "arrivals")
