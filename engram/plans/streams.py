"""Queries: streams over the given tables, run to their end, and windows over arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.session import Scratch
from engram.sources import views
from engram.streaming import typed_state, windows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Files that a table arrives in, one per batch.
ARRIVALS = 4


def query(name: str, oracle: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, views.oracle(oracle)
        return f

    return register


def _streamed(spark: SparkSession, rows: DataFrame, by: str, schema: str, process, result: str, *key: str) -> DataFrame:
    """The rows arrive in files dealt by hash, so in no order of time; what each key came out with last."""
    scratch = Scratch(spark)
    source = scratch.keep(rows.repartition(ARRIVALS, by)).inputFiles()[0].rpartition("/")[0]
    out, state = f"{scratch.root}/out", f"{scratch.root}/state"
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    typed_state.run(process(arriving), out, state)
    return typed_state.latest(spark, out, result, *key)


def _arrived_versions(facts: DataFrame) -> DataFrame:
    return typed_state.stream_versions(facts, typed_state.ArrivedVersions)


@query(
    "facts_streamed",
    "SELECT user_id AS subject_id, event_id AS fact_id, event_type AS predicate, value, epoch_us(ts) AS start, epoch_us(lead(ts) OVER slot) AS end, lead(event_id) OVER slot AS successor "
    "FROM events WINDOW slot AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)",
)
def facts_streamed(spark, sf_dir):
    """Versions of all facts from a stream that delivers them out of order: typed list state, one entry per batch and subject."""
    events = views.table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("subject_id"), F.col("event_id").alias("fact_id"), F.col("event_type").alias("predicate"), "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    return _streamed(spark, rows, "fact_id", typed_state.FACT, _arrived_versions, typed_state.VERSION, "subject_id", "fact_id")


@query(
    "contexts_streamed",
    "SELECT subject_id, session_id, turn_id, coalesce(list_aggregate(list(turn_id) OVER (PARTITION BY subject_id, session_id ORDER BY turn_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 'string_agg', ','), '') AS context FROM v_turns",
)
def contexts_streamed(spark, sf_dir):
    """The six turns before each turn from a stream out of order: typed list state, one entry per turn of a session."""
    rows = views.table(spark, sf_dir, "v_turns").select("subject_id", "session_id", "turn_id")
    found = _streamed(spark, rows, "turn_id", typed_state.TURN, typed_state.stream_contexts, typed_state.CONTEXT, "subject_id", "session_id", "turn_id")
    return found.withColumn("context", F.array_join(F.transform("context", lambda t: t.cast("string")), ","))


_EVENTS = "SELECT user_id AS subject_id, ts AS occurred_at FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL"


@query(
    "activity_sessions",
    # gaps and islands: a row that comes six hours or more after the one before begins a session
    f"SELECT subject_id, min(occurred_at) AS started, max(occurred_at) + INTERVAL 6 HOUR AS ended, count(*) AS arrivals FROM (SELECT *, sum(begins) OVER (PARTITION BY subject_id ORDER BY occurred_at ROWS UNBOUNDED PRECEDING) AS island FROM "
    f"(SELECT *, CASE WHEN occurred_at - lag(occurred_at) OVER (PARTITION BY subject_id ORDER BY occurred_at) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM ({_EVENTS}))) GROUP BY subject_id, island",
)
def activity_sessions(spark, sf_dir):
    """Stretches of a subject's activity without six quiet hours."""
    rows = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), F.col("ts").alias("occurred_at"))
    return _untimed(windows.sessions(rows, gap="6 hours"))


@query(
    "activity_windows",
    "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS started, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ended, count(*) AS arrivals FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL",
)
def activity_windows(spark, sf_dir):
    """Arrivals per kind and hour."""
    rows = views.table(spark, sf_dir, "events").select("event_type", F.col("ts").alias("occurred_at"))
    return _untimed(windows.tumbling(rows, key="event_type"))


def _untimed(rows: DataFrame) -> DataFrame:
    """Times without a zone, as in all tables here."""
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})
