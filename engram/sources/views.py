"""The engine's tables derived from the driver's tables, as DataFrames and as SQL for the oracle (same rules)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.session import tasks_for

SPARK_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: SQL of each derived table; timestamps are without zone on both engines.
SQL = {
    "v_turns": "SELECT conv_id * 1000 + turn AS turn_id, conv_id AS subject_id, conv_id AS session_id, role, text AS content, "
    "TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 1000 + turn) * INTERVAL '1' MINUTE AS occurred_at FROM conversations",
    "v_facts": "SELECT fact_id, subject_id, predicate, value, valid_from, succ_ts AS valid_to, recorded_at, "
    "succ_ts + (succ_id % 7) * INTERVAL '1' HOUR AS invalidated_at, CASE WHEN predicate = 'error' AND fact_id % 5 = 0 AND succ_id IS NOT NULL THEN 'retracted' "
    "WHEN succ_id IS NOT NULL THEN 'superseded' ELSE 'active' END AS status, fact_id - fact_id % 3 AS origin_turn, fact_id % 30 < 4 AS to_erase FROM ("
    "SELECT event_id AS fact_id, user_id AS subject_id, event_type AS predicate, value, ts AS valid_from, ts + (event_id % 7) * INTERVAL '1' HOUR AS recorded_at, "
    "LEAD(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS succ_id, "
    "LEAD(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS succ_ts FROM events) e",
    "v_lineage": "SELECT event_id AS fact_id, LAG(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS parent_id, "
    "CASE WHEN LAG(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) IS NULL THEN 'add' ELSE 'update' END AS op, event_id AS trace_id FROM events",
    # what each fact was derived from: its predecessor, for some also the one before it (merges), and circles of two
    "v_derivations": "SELECT fact_id, parent_id FROM (SELECT event_id AS fact_id, LAG(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS parent_id FROM events "
    "UNION ALL SELECT event_id, CASE WHEN event_id % 4 = 0 THEN LAG(event_id, 2) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) END FROM events "
    "UNION ALL SELECT event_id, CASE WHEN user_id % 10 = 0 AND LAG(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) IS NULL "
    "THEN LEAD(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) END FROM events) d WHERE parent_id IS NOT NULL",
    "v_edges": "SELECT 1000000 + c_custkey AS src, 'lives_in' AS predicate, CAST(1000 + c_nationkey AS BIGINT) AS dst FROM customer "
    "UNION ALL SELECT 2000000 + s_suppkey, 'based_in', 1000 + s_nationkey FROM supplier UNION ALL SELECT 1000 + n_nationkey, 'part_of', 1 + n_regionkey FROM nation",
    "v_entities": "SELECT 1000000 + c_custkey AS entity_id, c_name AS name, 'person' AS kind FROM customer UNION ALL SELECT 2000000 + s_suppkey, s_name, 'organisation' FROM supplier "
    "UNION ALL SELECT 1000 + n_nationkey, n_name, 'ort' FROM nation UNION ALL SELECT 1 + r_regionkey, r_name, 'region' FROM region",
    "v_docs": "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, e.embedding, coalesce(e.label, CAST(d.doc_id % 10 AS INTEGER)) AS label FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id",
    "v_traces": "SELECT event_id AS trace_id, user_id AS subject_id, CASE WHEN event_id % 3 = 0 THEN 'read' ELSE 'write' END AS kind, "
    "CASE WHEN event_id % 3 = 0 THEN event_type END AS query, ts AS started_at FROM events",
    "v_steps": "SELECT event_id AS step_id, event_id AS trace_id, 1 + event_id % 4 AS stage, props AS input, CASE WHEN event_id % 10 = 0 THEN ts END AS redacted_at, "
    "chr(123) || '\"included\": [' || event_id || '], \"fused\": [' || chr(123) || '\"fact_id\": ' || (event_id - event_id % 10) || chr(125) || '], \"neighbours\": [' || "
    "chr(123) || '\"id\": ' || (event_id - event_id % 7) || chr(125) || ']' || chr(125) AS output FROM events",
    "v_probes": "SELECT doc_id AS probe_id, CASE doc_id % 4 WHEN 0 THEN 'update_recall' WHEN 1 THEN 'stale' WHEN 2 THEN 'false_retraction' ELSE 'erasure' END AS kind, "
    "CASE WHEN toxic = 1 THEN 'unsupported' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS outcome FROM labels",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or one derived from them."""
    if name in SQL:
        return sql(spark, sf_dir, SQL[name])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_slot(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table derived by windows over the slots of ``events``, dealt to tasks of a bounded size once for all its windows."""
    events = table(spark, sf_dir, "events")
    return sql(spark, sf_dir, SQL[name], events=events.repartition(tasks_for(spark, events.count()), "user_id", "event_type"))


def _used(text: str) -> list[str]:
    return [t for t in (*SQL, *SPARK_TABLES) if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text)]


def sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL over driver tables, derived tables and ``frames`` by their names; nothing is registered in the catalog."""
    found = {t: table(spark, sf_dir, t) for t in _used(text) if t not in frames} | frames
    for t in found:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(re.sub(r"\bTIMESTAMP '", "TIMESTAMP_NTZ '", text), **found)


def oracle(text: str) -> str:
    """The same SQL for the oracle, with the derived tables that it uses in front."""
    need = [t for t in SQL if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text)]
    if not need:
        return text
    head = ", ".join(f"{t} AS ({SQL[t]})" for t in need)
    body = text.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE') :]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {head} {body}"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned facts: a successor in the same slot closes its predecessor (validity derivation by LEAD)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "ts")
    slot = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    succ_id, succ_ts = F.lead("event_id").over(slot), F.lead("ts").over(slot)
    hours = lambda n: F.make_dt_interval(hours=(n % 7).cast("int"))
    e = e.withColumns({"succ_id": succ_id, "valid_to": succ_ts})
    status = F.when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0) & F.col("succ_id").isNotNull(), "retracted").when(F.col("succ_id").isNotNull(), "superseded").otherwise("active")
    return e.select(
        F.col("event_id").alias("fact_id"), F.col("user_id").alias("subject_id"), F.col("event_type").alias("predicate"), "value", F.col("ts").alias("valid_from"), "valid_to",
        (F.col("ts") + hours(F.col("event_id"))).alias("recorded_at"), (F.col("valid_to") + hours(F.col("succ_id"))).alias("invalidated_at"), status.alias("status"),
        (F.col("event_id") - F.col("event_id") % 3).alias("origin_turn"), (F.col("event_id") % 30 < 4).alias("to_erase"),
    )
