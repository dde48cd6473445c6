"""Queries: bitemporal predicates, projections, histories, aggregates over facts, turns and traces."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions.vector import cosine, embed_text, embedder
from engram.operators import intervals
from engram.operators.asof import as_of, edges_at
from engram.operators.chains import ChainIndex
from engram.operators.history import adjacency, neighbourhood
from engram.sources import views

TX, VALID = "2024-01-15 00:00:00", "2024-01-12 00:00:00"
FACT = ("fact_id", "subject_id", "predicate", "value", "valid_from", "valid_to", "status")
_FACT = ", ".join(FACT)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def shared(name: str, text: str) -> None:
    """A query whose SQL both engines understand."""
    QUERIES[name] = lambda spark, sf_dir: views.sql(spark, sf_dir, text)
    ORACLE_SQL[name] = views.oracle(text)


def query(name: str, oracle: str):
    """Register a DataFrame function (spark, sf_dir) under a name, with its oracle."""

    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, views.oracle(oracle)
        return f

    return register


# -- as-of ------------------------------------------------------------------------------------------------------------

_VALID = f"valid_from <= TIMESTAMP '{VALID}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{VALID}')"
_TX = f"recorded_at <= TIMESTAMP '{TX}' AND (invalidated_at IS NULL OR invalidated_at > TIMESTAMP '{TX}')"
for _name, _tx, _valid, _where in (
    ("asof_current", None, None, "invalidated_at IS NULL"),
    ("asof_tx", TX, None, _TX),
    ("asof_valid", None, VALID, f"status <> 'retracted' AND {_VALID}"),
    ("asof_both", TX, VALID, f"{_TX} AND {_VALID}"),
):
    QUERIES[_name] = lambda spark, sf_dir, tx=_tx, valid=_valid: views.facts(spark, sf_dir).filter(as_of(tx, valid)).select(*FACT)
    ORACLE_SQL[_name] = views.oracle(f"SELECT {_FACT} FROM v_facts WHERE status <> 'erased' AND {_where}")


@query("visible_facts", f"SELECT {_FACT} FROM v_facts WHERE fact_id IN (SELECT parent_id FROM v_lineage) AND status <> 'erased' AND {_TX}")
def visible_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final gate of retrieval: a list of ids (here all facts that something is derived from) through the predicate."""
    ids = views.table(spark, sf_dir, "v_lineage").select(F.col("parent_id").alias("fact_id")).distinct()
    return views.facts(spark, sf_dir).filter(as_of(TX)).join(ids, "fact_id", "left_semi").select(*FACT)


@query(
    "active_facts",
    f"SELECT {_FACT}, row_number() OVER (PARTITION BY subject_id ORDER BY valid_from DESC, fact_id DESC) AS place FROM v_facts WHERE invalidated_at IS NULL",
)
def active_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject's visible facts in display order; ``place`` is what limit and offset of a page refer to."""
    order = Window.partitionBy("subject_id").orderBy(F.desc("valid_from"), F.desc("fact_id"))
    return views.facts(spark, sf_dir).filter(as_of()).select(*FACT).withColumn("place", F.row_number().over(order).cast("long"))


shared("all_facts", f"SELECT {_FACT}, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY recorded_at, fact_id) AS BIGINT) AS place FROM v_facts")
shared("active_count", "SELECT subject_id, count(*) AS active FROM v_facts WHERE status = 'active' AND invalidated_at IS NULL GROUP BY subject_id")
shared(
    "list_subjects",
    "SELECT t.subject_id, t.turns, t.last_turn, coalesce(a.active, 0) AS active FROM (SELECT subject_id, count(*) AS turns, max(occurred_at) AS last_turn FROM v_turns GROUP BY subject_id) t "
    "LEFT JOIN (SELECT subject_id, count(*) AS active FROM v_facts WHERE status = 'active' GROUP BY subject_id) a ON t.subject_id = a.subject_id",
)


@query("scd2_supersede", f"SELECT {_FACT}, recorded_at, invalidated_at FROM v_facts WHERE status <> 'active'")
def scd2_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that their successor closed."""
    return views.facts(spark, sf_dir).filter("status <> 'active'").select(*FACT, "recorded_at", "invalidated_at")


@query(
    "close_facts",
    f"SELECT fact_id, CASE WHEN invalidated_at IS NULL AND predicate = 'error' THEN coalesce(valid_to, TIMESTAMP '{TX}') ELSE valid_to END AS valid_to, "
    f"CASE WHEN invalidated_at IS NULL AND predicate = 'error' THEN TIMESTAMP '{TX}' ELSE invalidated_at END AS invalidated_at, "
    "CASE WHEN invalidated_at IS NULL AND predicate = 'error' THEN 'retracted' ELSE status END AS status FROM v_facts",
)
def close_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retract the open facts of a slot: idempotent, and an end of validity that is known already stays."""
    facts, now = views.facts(spark, sf_dir), F.lit(TX).cast("timestamp_ntz")
    closes = F.col("invalidated_at").isNull() & (F.col("predicate") == "error")
    return facts.select(
        "fact_id", F.when(closes, F.coalesce("valid_to", now)).otherwise(F.col("valid_to")).alias("valid_to"), F.when(closes, now).otherwise(F.col("invalidated_at")).alias("invalidated_at"),
        F.when(closes, "retracted").otherwise(F.col("status")).alias("status"),
    )


# -- interval joins ---------------------------------------------------------------------------------------------------

def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


@query(
    "facts_at_turns",
    "SELECT t.turn_id, count(*) AS facts, min(f.fact_id) AS first_fact, max(f.fact_id) AS last_fact FROM v_turns t JOIN v_facts f ON f.valid_from <= t.occurred_at AND (f.valid_to IS NULL OR f.valid_to > t.occurred_at) GROUP BY t.turn_id",
)
def facts_at_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was true when each turn was said, over all subjects: figures of an interval join without an equal key, without its pairs."""
    turns = views.table(spark, sf_dir, "v_turns").select("turn_id", _micros("occurred_at").alias("at"))
    facts = views.facts(spark, sf_dir).select("fact_id", _micros("valid_from").alias("start"), _micros("valid_to").alias("end"))
    held = turns.join(intervals.tally_at(turns, facts, "fact_id"), "at")
    return held.groupBy("turn_id").agg(F.sum("n").alias("facts"), F.min("least").alias("first_fact"), F.max("greatest").alias("last_fact"))


@query(
    "facts_side_by_side",
    "SELECT a.subject_id, a.predicate AS one, b.predicate AS other, count(*) AS pairs FROM v_facts a JOIN v_facts b ON a.subject_id = b.subject_id AND a.predicate < b.predicate "
    "AND (b.valid_to IS NULL OR a.valid_from < b.valid_to) AND (a.valid_to IS NULL OR b.valid_from < a.valid_to) AND (a.valid_to IS NULL OR a.valid_from < a.valid_to) AND (b.valid_to IS NULL OR b.valid_from < b.valid_to) "
    "GROUP BY a.subject_id, a.predicate, b.predicate",
)
def facts_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two slots of a subject held at the same time: figures of an interval join within each subject."""
    facts = views.facts(spark, sf_dir).select("subject_id", "predicate", _micros("valid_from").alias("start"), _micros("valid_to").alias("end"))
    return intervals.count_overlaps(facts, "subject_id", "predicate")


# -- turns, traces, steps ---------------------------------------------------------------------------------------------

shared("turns_projection", "SELECT turn_id, subject_id, session_id, role, content, coalesce(occurred_at, TIMESTAMP '2024-01-01 00:00:00') AS occurred_at FROM v_turns")
shared(
    "list_turns",
    "SELECT turn_id, subject_id, role, occurred_at, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY occurred_at, turn_id) AS BIGINT) AS place FROM v_turns",
)
#: A page: so many rows after so many (the feature's limit).
PAGE, AFTER = 50, 100
shared("list_turns_page", f"SELECT turn_id, subject_id, role, occurred_at FROM v_turns ORDER BY occurred_at, turn_id LIMIT {PAGE} OFFSET {AFTER}")
shared("list_facts_page", f"SELECT {_FACT}, recorded_at FROM v_facts WHERE status <> 'erased' ORDER BY recorded_at, fact_id LIMIT {PAGE} OFFSET {AFTER}")
shared("list_traces_page", f"SELECT trace_id, subject_id, kind, query, started_at FROM v_traces WHERE kind = 'read' ORDER BY started_at DESC, trace_id DESC LIMIT {PAGE} OFFSET {AFTER}")
shared(
    "list_traces",
    "SELECT trace_id, subject_id, kind, query, started_at, CAST(row_number() OVER (PARTITION BY subject_id, kind ORDER BY started_at DESC, trace_id DESC) AS BIGINT) AS place FROM v_traces",
)
shared("trace_steps", "SELECT t.trace_id, t.kind, s.step_id, s.stage, s.input FROM v_steps s JOIN v_traces t ON s.trace_id = t.trace_id")
shared("point_lookup", "SELECT trace_id, kind, started_at FROM v_traces WHERE trace_id IN (SELECT fact_id FROM v_facts WHERE status = 'retracted')")
shared("redacted_turns", "SELECT turn_id, CASE WHEN turn_id % 5 = 0 THEN '(gelöscht)' ELSE content END AS content FROM v_turns")


@query(
    "context_turns",
    "SELECT turn_id, coalesce(string_agg(before, ',' ORDER BY before), '') AS context FROM (SELECT a.turn_id, b.turn_id AS before, row_number() OVER (PARTITION BY a.turn_id ORDER BY b.turn_id DESC) AS n "
    "FROM v_turns a LEFT JOIN v_turns b ON a.subject_id = b.subject_id AND a.session_id = b.session_id AND b.turn_id < a.turn_id) WHERE n <= 6 GROUP BY turn_id",
)
def context_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six turns of the session before each turn, in order."""
    before = Window.partitionBy("subject_id", "session_id").orderBy("turn_id").rowsBetween(-6, -1)
    turns = views.table(spark, sf_dir, "v_turns")
    return turns.select("turn_id", F.array_join(F.transform(F.collect_list("turn_id").over(before), lambda t: t.cast("string")), ",").alias("context"))


shared(
    "retention_candidates",
    "SELECT s.step_id, t.trace_id, t.started_at FROM v_steps s JOIN v_traces t ON s.trace_id = t.trace_id WHERE t.started_at < TIMESTAMP '2024-02-14 00:00:00' - INTERVAL '30' DAY AND s.redacted_at IS NULL",
)
shared(
    "receipts",
    "SELECT subject_id, max(recorded_at) AS executed_at, count(*) AS affected FROM v_facts WHERE to_erase GROUP BY subject_id ORDER BY executed_at DESC, subject_id DESC LIMIT 100",
)
_COUNTS = " UNION ALL ".join(f"SELECT '{t[2:]}' AS table_name, count(*) AS row_count FROM {t}" for t in ("v_turns", "v_facts", "v_traces", "v_steps", "v_lineage", "v_entities", "v_edges"))
shared("storage_counts", f"SELECT table_name, row_count, CAST(row_number() OVER (ORDER BY row_count DESC, table_name) AS BIGINT) AS place FROM ({_COUNTS}) c")
_LABELS = {"active": "aktiv", "superseded": "abgelöst", "retracted": "zurückgezogen", "erased": "gelöscht"}


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in _LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, status), status)


@query("status_labels", "SELECT fact_id, CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items()) + " ELSE status END AS label FROM v_facts")
def status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display labels by a map lookup; a status without a label stays as it is."""
    return views.facts(spark, sf_dir).select("fact_id", status_label(F.col("status")).alias("label"))


shared("purgeable", "SELECT subject_id, name FROM (SELECT subject_id, CASE WHEN subject_id % 3 = 0 THEN 'replay:' WHEN subject_id % 3 = 1 THEN 'eval:' ELSE 'user:' END || subject_id AS name "
       "FROM v_turns GROUP BY subject_id) n WHERE name LIKE 'replay:%' OR name LIKE 'eval:%'")  # fmt: skip


@query("json_predicate", "SELECT step_id, json_extract_string(input, '$.k') AS k FROM v_steps WHERE json_extract_string(input, '$.k') IN ('1', '2', '3', '5', '8', '13', '21')")
def json_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member of the JSON text is one of a list."""
    k = F.get_json_object("input", "$.k")
    return views.table(spark, sf_dir, "v_steps").select("step_id", k.alias("k")).filter(F.col("k").isin("1", "2", "3", "5", "8", "13", "21"))


# -- lineage ----------------------------------------------------------------------------------------------------------

_OWN = "SELECT fact_id AS about, fact_id, parent_id, op, trace_id FROM v_lineage UNION ALL SELECT parent_id AS about, fact_id, parent_id, op, trace_id FROM v_lineage WHERE parent_id IS NOT NULL"
shared("lineage_for_fact", f"SELECT l.about, l.fact_id, l.parent_id, l.op, t.trace_id, t.kind, t.started_at FROM ({_OWN}) l JOIN v_traces t ON l.trace_id = t.trace_id")
shared("lineage_for_trace", "SELECT l.trace_id, l.fact_id, l.op, f.status, f.predicate FROM v_lineage l LEFT JOIN v_facts f ON l.parent_id = f.fact_id")
shared(
    "fact_history",
    "SELECT l.fact_id, l.op, t.started_at, u.role, p.status AS parent_status, CASE l.op WHEN 'add' THEN 'neu' WHEN 'update' THEN 'aktualisiert' ELSE l.op END AS label "
    "FROM v_lineage l JOIN v_traces t ON l.trace_id = t.trace_id LEFT JOIN v_turns u ON t.trace_id = u.turn_id LEFT JOIN v_facts p ON l.parent_id = p.fact_id",
)


@query(
    "export_history",
    f"SELECT about AS fact_id, count(*) AS entries, string_agg(fact_id || ':' || CASE WHEN about = fact_id THEN op ELSE 'superseded' END, ',' ORDER BY fact_id) AS history FROM ({_OWN}) GROUP BY about",
)
def export_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries per fact; a parent gets the entry of what superseded it too. An OR of two keys, as a union of two equal ones."""
    lineage = views.table(spark, sf_dir, "v_lineage")
    own = lineage.select(F.col("fact_id").alias("about"), "fact_id", F.col("op").alias("note"))
    views_of_parent = lineage.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("about"), "fact_id", F.lit("superseded").alias("note"))
    met = own.union(views_of_parent).groupBy("about").agg(F.count(F.lit(1)).alias("entries"), F.array_sort(F.collect_list(F.struct("fact_id", "note"))).alias("all"))
    told = F.transform("all", lambda e: F.concat(e["fact_id"].cast("string"), F.lit(":"), e["note"]))
    return met.select(F.col("about").alias("fact_id"), "entries", F.array_join(told, ",").alias("history"))


@query(
    "lineage_closure",
    "WITH RECURSIVE c AS (SELECT event_id AS root, event_id AS fact_id FROM events UNION SELECT c.root, l.fact_id FROM c JOIN v_derivations l ON l.parent_id = c.fact_id) SELECT root, fact_id FROM c",
)
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact with all that was derived from it, over merges and circles too, from the stored chain index."""
    return derivations(spark, sf_dir).closure(views.table(spark, sf_dir, "events").select(F.col("event_id").alias("root")))


def derivations(spark: SparkSession, sf_dir: str) -> ChainIndex:
    """The chain index of what was derived from what; built when the table of events has none yet."""
    return ChainIndex.stored(views.by_slot(spark, sf_dir, "v_derivations"), "derivations")


shared(
    "timeline",
    "SELECT origin_turn, op, count(*) AS changes FROM (SELECT f.origin_turn, l.op FROM v_lineage l JOIN v_traces t ON l.trace_id = t.trace_id JOIN v_facts f ON l.fact_id = f.fact_id) x GROUP BY origin_turn, op",
)
shared(
    "export_facts",
    "SELECT f.fact_id, f.subject_id, f.predicate, f.status, t.started_at AS source_at, t.kind AS source_kind FROM v_facts f LEFT JOIN v_traces t ON f.origin_turn = t.trace_id WHERE f.status <> 'erased'",
)
shared(
    "export_truncation",
    "SELECT subject_id, CAST(least(n, 50) AS BIGINT) AS exported, n <= 50 AS complete FROM (SELECT subject_id, count(*) AS n FROM v_facts GROUP BY subject_id) c",
)

# -- graph ------------------------------------------------------------------------------------------------------------

_FACT_EDGES = "SELECT src, predicate, dst, src * 10000 + dst AS fact_id FROM v_edges"
shared(
    "graph_edges",
    "SELECT e.src, s.name AS src_name, s.kind AS src_kind, e.predicate, e.dst, d.name AS dst_name, d.kind AS dst_kind FROM v_edges e JOIN v_entities s ON e.src = s.entity_id JOIN v_entities d ON e.dst = d.entity_id",
)


@query("undirected_adjacency", "SELECT node, count(*) AS degree FROM (SELECT src AS node, dst AS other FROM v_edges UNION ALL SELECT dst, src FROM v_edges) GROUP BY node")
def undirected_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency(views.table(spark, sf_dir, "v_edges")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


@query(
    "graph_neighbourhood",
    f"WITH RECURSIVE e AS ({_FACT_EDGES}), a AS (SELECT src AS node, dst AS other FROM e UNION ALL SELECT dst, src FROM e), "
    "n AS (SELECT entity_id AS node, 0 AS hop FROM v_entities WHERE lower(name) IN ('nation_1', 'nation_7') UNION SELECT a.other, n.hop + 1 FROM n JOIN a ON n.node = a.node WHERE n.hop < 2) "
    "SELECT fact_id, min(hop) + 1 AS hop FROM (SELECT e.fact_id, n.hop FROM e JOIN n ON e.src = n.node UNION ALL SELECT e.fact_id, n.hop FROM e JOIN n ON e.dst = n.node) GROUP BY fact_id",
)
def graph_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.table(spark, sf_dir, "v_edges").withColumn("fact_id", F.col("src") * 10000 + F.col("dst"))
    seeds = views.table(spark, sf_dir, "v_entities").filter(F.lower("name").isin("nation_1", "nation_7")).select(F.col("entity_id").alias("node"))
    return neighbourhood(edges, seeds)


@query(
    "graph_asof",
    f"SELECT subject_id AS src, predicate, origin_turn AS dst, fact_id, valid_from, count(*) OVER (PARTITION BY subject_id) AS edges_of_src FROM v_facts WHERE {_VALID}",
)
def graph_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at an instant: validity only."""
    edges = views.facts(spark, sf_dir).filter(edges_at(VALID)).select(F.col("subject_id").alias("src"), "predicate", F.col("origin_turn").alias("dst"), "fact_id", "valid_from")
    return edges.withColumn("edges_of_src", F.count(F.lit(1)).over(Window.partitionBy("src")))


#: Edges that an erasure leaves: those of persons whose account is overdrawn go.
_LEFT = "SELECT e.src, e.dst FROM v_edges e LEFT ANTI JOIN (SELECT 1000000 + c_custkey AS src FROM customer WHERE c_acctbal < 0) g ON e.src = g.src"
ORPHANS = "SELECT e.entity_id, e.name FROM v_entities e LEFT ANTI JOIN (SELECT src AS entity_id FROM v_edges UNION SELECT dst FROM v_edges) k ON e.entity_id = k.entity_id"
shared("orphan_entities", ORPHANS.replace("FROM v_edges", f"FROM ({_LEFT}) l"))
ORACLE_SQL["orphan_entities"] = views.oracle(
    "SELECT e.entity_id, e.name FROM v_entities e WHERE NOT EXISTS (SELECT 1 FROM v_edges d WHERE (d.src = e.entity_id OR d.dst = e.entity_id) "
    "AND d.src NOT IN (SELECT 1000000 + c_custkey FROM customer WHERE c_acctbal < 0))"
)


@query(
    "entity_upsert",
    "SELECT name, kind, min(first_id) AS entity_id, coalesce(max(old_weight), max(new_weight)) AS weight FROM (SELECT name, kind, entity_id AS first_id, CASE WHEN entity_id % 2 = 0 THEN entity_id END AS old_weight, NULL AS new_weight FROM v_entities "
    "UNION ALL SELECT c_name, CASE WHEN c_custkey % 2 = 0 THEN 'person' END, 9000000 + c_custkey, NULL, c_custkey FROM customer) GROUP BY name, kind",
)
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert or keep: keys match null-safely, and a value that is there is never overwritten."""
    old = views.table(spark, sf_dir, "v_entities").select("name", "kind", F.col("entity_id"), F.when(F.col("entity_id") % 2 == 0, F.col("entity_id")).alias("weight"))
    new = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "person").alias("kind"), (F.col("c_custkey") + 9000000).alias("entity_id"), F.col("c_custkey").alias("new_weight")
    )
    both = old.withColumn("new_weight", F.lit(None).cast("long")).unionByName(new.withColumn("weight", F.lit(None).cast("long")))
    return both.groupBy("name", "kind").agg(F.min("entity_id").alias("entity_id"), F.coalesce(F.max("weight"), F.max("new_weight")).alias("weight"))


@query(
    "close_edges",
    f"SELECT fact_id, CASE WHEN valid_to IS NULL AND to_erase THEN TIMESTAMP '{TX}' ELSE valid_to END AS valid_to FROM v_facts",
)
def close_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open edges of closed facts get the end of their fact."""
    facts = views.facts(spark, sf_dir)
    closed = facts.filter("to_erase").select(F.col("fact_id").alias("closed_id"))
    edges = facts.select("fact_id", "valid_to").join(closed, F.col("fact_id") == F.col("closed_id"), "left")
    return edges.select("fact_id", F.when(F.col("valid_to").isNull() & F.col("closed_id").isNotNull(), F.lit(TX).cast("timestamp_ntz")).otherwise(F.col("valid_to")).alias("valid_to"))


SEED_QUESTION, SEEDS = "Who is in NATION_1 or in nation 7 of Asia?", 5


def seeds(entities: DataFrame, question: str, kinds: str = "kind", most: int = SEEDS) -> DataFrame:
    """``entities`` (entity_id, name) of each kind that a question starts from, with ``similarity, place``: names that are
    a word of it, then the nearest by hashed embedding of the name; at most ``most`` of a kind (the feature's limit)."""
    asked = F.array(*[F.lit(float(x)) for x in embed_text(question, 256, {})])
    words = sorted({w.casefold() for w in re.findall(r"\w{2,}", question)})
    rows = entities.select("entity_id", "name", kinds, F.round(cosine(embedder(256)(F.col("name")), asked), 6).alias("similarity"), F.lower("name").isin(*words).alias("hit"))
    order = Window.partitionBy(kinds).orderBy(F.desc("hit"), F.when(~F.col("hit"), -F.col("similarity")), "entity_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most)


def seed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No oracle: SQL has no hashed embedding; a test holds it against brute force."""
    return seeds(views.table(spark, sf_dir, "v_entities"), SEED_QUESTION).select("entity_id", "name", "similarity", "place")


QUERIES["seed_entities"] = seed_entities


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts valid at an instant, counted per predicate."""
    return views.facts(spark, sf_dir).filter(as_of(valid=VALID)).groupBy("predicate").agg(F.count(F.lit(1)).alias("facts"), F.round(F.sum("value"), 4).alias("total"))


query("flagship", f"SELECT predicate, count(*) AS facts, round(sum(value), 4) AS total FROM v_facts WHERE status <> 'retracted' AND {_VALID} GROUP BY predicate")(flagship)
