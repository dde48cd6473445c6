"""Queries: extraction, coercion, policy, what decisions write."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engram.functions.json_text import model_object, redact
from engram.functions.text import normalise
from engram.operators import consolidation as C
from engram.operators import extraction as E
from engram.operators.extraction_udtf import extract_steps as record_steps
from engram.operators.extraction_udtf import extract_table
from engram.sources import views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, views.oracle(oracle)
        return f

    return register


# -- extraction -------------------------------------------------------------------------------------------------------

_SAID = (
    "SELECT c_custkey AS turn_id, CASE WHEN c_custkey % 11 = 0 THEN 'assistant' ELSE 'user' END AS role, TIMESTAMP '2024-06-15 00:00:00' AS occurred_at, "
    "CASE c_custkey % 8 WHEN 0 THEN 'Hallo. Ich wohne jetzt in ' || n_name || '.' WHEN 1 THEN 'I work at ' || c_name || '. Is it ' || c_mktsegment || '?' "
    "WHEN 2 THEN 'Ich mag keine ' || c_mktsegment || '! Ich mag ' || n_name || '.' WHEN 3 THEN 'Ich glaube, ich bin nach ' || n_name || ' gezogen.' "
    "WHEN 4 THEN 'Vergiss, was ich über meinen Arbeitgeber gesagt habe.' WHEN 5 THEN 'Ich bin gerade in ' || n_name || '. Ich bin gerade in ' || n_name || '.' "
    "WHEN 6 THEN 'Das ist so.' ELSE 'Ich heiße ' || c_name || '; Ich liebe es' END AS content, c_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey"
)


_CANDIDATES = (
    f"WITH s AS ({_SAID}) SELECT turn_id, predicate, content, confidence FROM ("
    "SELECT turn_id, role, 'wohnt_in' AS predicate, 'Wohnt in ' || n_name || '.' AS content, 0.85::DOUBLE AS confidence FROM s WHERE turn_id % 8 = 0 "
    "UNION ALL SELECT turn_id, role, 'arbeitet_bei', 'Arbeitet bei ' || c_name || '.', 0.85 FROM s WHERE turn_id % 8 = 1 "
    "UNION ALL SELECT turn_id, role, 'mag_nicht', 'Mag kein ' || c_mktsegment || '.', 0.85 FROM s WHERE turn_id % 8 = 2 UNION ALL SELECT turn_id, role, 'mag', 'Mag ' || n_name || '.', 0.85 FROM s WHERE turn_id % 8 = 2 "
    "UNION ALL SELECT turn_id, role, 'wohnt_in', 'Wohnt in ' || n_name || '.', 0.6 FROM s WHERE turn_id % 8 = 3 "
    "UNION ALL SELECT turn_id, role, NULL, 'Widerruf: Angaben zu „meinen Arbeitgeber“ sollen vergessen werden.', 0.9 FROM s WHERE turn_id % 8 = 4 "
    "UNION ALL SELECT turn_id, role, 'status', 'Ist zurzeit ' || n_name || '.', 0.85 FROM s WHERE turn_id % 8 = 5 "
    "UNION ALL SELECT turn_id, role, 'heisst', 'Heißt ' || c_name || '; Ich liebe es.', 0.85 FROM s WHERE turn_id % 8 = 7) WHERE role = 'user'"
)


@query("extract_assertions", _CANDIDATES)
def extract_assertions(spark, sf_dir):
    """Sentences made from all customers, through the pattern table."""
    found = E.extract(views.sql(spark, sf_dir, _SAID))
    return found.filter("reason IS NULL").select("turn_id", "predicate", "content", "confidence")


@query("extract_candidates", f"SELECT *, predicate IS NOT DISTINCT FROM 'status' AS temporary FROM ({_CANDIDATES})")
def extract_candidates(spark, sf_dir):
    """The same turns through the Arrow table function, with the flag of passing states."""
    return extract_table(views.sql(spark, sf_dir, _SAID)).select("turn_id", "predicate", "content", "confidence", "temporary")


_EST = "greatest(1, (length(coalesce({}, '')) + 3) // 4)"


@query(
    "extract_steps",
    f"SELECT s.turn_id, 'extract' AS stage, 'patterns' AS model, CAST({_EST.format('s.content')} AS BIGINT) AS tokens_in, CAST(coalesce(sum({_EST.format('c.content')}) FILTER (c.content IS NOT NULL), 0) AS BIGINT) AS tokens_out, "
    f"count(c.content) AS candidates, true AS timed FROM ({_SAID}) s LEFT JOIN ({_CANDIDATES}) c ON s.turn_id = c.turn_id GROUP BY s.turn_id, s.content",
)
def extract_steps(spark, sf_dir):
    """What the recorder keeps of extracting: a step per turn with model, tokens, duration and yield."""
    steps = record_steps(views.sql(spark, sf_dir, _SAID))
    return steps.select("turn_id", "stage", "model", "tokens_in", "tokens_out", "candidates", (F.col("duration_us") >= 0).alias("timed"))


_SINCE = (
    "SELECT o_orderkey AS id, o_orderdate AS reference, CASE o_orderkey % 5 WHEN 0 THEN 'Ich wohne seit ' || CASE o_orderkey % 3 WHEN 0 THEN 'März' WHEN 1 THEN 'Dezember' ELSE 'dem Mai' END || ' hier' "
    "WHEN 1 THEN 'since ' || CASE o_orderkey % 2 WHEN 0 THEN 'June' ELSE 'October' END || ' ' || (1990 + o_orderkey % 30) WHEN 2 THEN 'seit ' || (1990 + o_orderkey % 30) WHEN 3 THEN 'seit gestern' ELSE 'ohne Angabe' END AS sentence FROM orders"
)


@query(
    "parse_since",
    f"WITH s AS ({_SINCE}), m AS (SELECT *, CASE id % 5 WHEN 0 THEN CASE id % 3 WHEN 0 THEN 3 WHEN 1 THEN 12 ELSE 5 END WHEN 1 THEN CASE id % 2 WHEN 0 THEN 6 ELSE 10 END ELSE 1 END AS month FROM s) "
    "SELECT id, CASE WHEN id % 5 = 0 THEN strftime(make_date(CASE WHEN make_date(year(reference), month, 1) > reference::DATE THEN year(reference) - 1 ELSE year(reference) END, month, 1), '%Y-%m-%d') "
    "WHEN id % 5 IN (1, 2) THEN strftime(make_date(1990 + id % 30, month, 1), '%Y-%m-%d') END AS since FROM m",
)
def parse_since(spark, sf_dir):
    rows = views.sql(spark, sf_dir, _SINCE).withColumn("folded", normalise("sentence"))
    return rows.select("id", E.since(F.col("sentence"), F.col("folded"), F.col("reference").cast("date")).cast("string").alias("since"))


_STAMPS = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN {iso} WHEN 1 THEN {day} WHEN 2 THEN 'gestern' END AS raw FROM events"


@query(
    "coerce_ts",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d') || ' 00:00:00' END AS at FROM events",
)
def coerce_ts(spark, sf_dir):
    """ISO with Z, a date alone, garbage and null to an instant in UTC."""
    raw = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 4 == 2, "gestern")
    at = F.try_to_timestamp(F.regexp_replace(raw, "Z$", "+00:00"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("parse_model_json", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract_string(props, '$.k') END AS k FROM events")
def parse_model_json(spark, sf_dir):
    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Gern:\n```json\n"), "props", F.lit("\n```\nfertig {nicht}"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("So: "), "props", F.lit(" das war's")))
    said = said.when(F.col("event_id") % 4 == 2, F.col("props")).otherwise("nichts {davon")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object(model_object(said), "$.k").alias("k"))


@query("redact_json", r"SELECT step_id, regexp_replace(input, ':\s*[^,}]+', ': null', 'g') AS input FROM v_steps")
def redact_json(spark, sf_dir):
    return views.table(spark, sf_dir, "v_steps").select("step_id", redact("input").alias("input"))


@query(
    "coerce_candidates",
    "SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN 'leer' WHEN length(text) > 500 THEN 'zu lang' WHEN n > 1 THEN 'Dublette' END AS reason, "
    "CASE WHEN role IN ('assert', 'retract', 'user') THEN role ELSE 'assert' END AS op_hint, round(greatest(0.0, least(1.0, CASE WHEN turn % 3 = 0 THEN turn * 0.3 WHEN turn % 3 = 1 THEN 0.5 ELSE -1.0 END))::DOUBLE, 6) AS confidence "
    "FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY turn) AS n FROM conversations)",
)
def coerce_candidates(spark, sf_dir):
    """Empty, too long and repeated candidates are refused with a reason; hints and confidences are brought into range."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    nth = F.row_number().over(Window.partitionBy("conv_id", F.lower("text")).orderBy("turn"))
    reason = F.when(F.coalesce("text", F.lit("")) == "", "leer").when(F.length("text") > E.MAX_CONTENT, "zu lang").when(nth > 1, "Dublette")
    raw = F.when(F.col("turn") % 3 == 0, (F.col("turn") * F.lit(0.3)).cast("string")).when(F.col("turn") % 3 == 1, "viel").otherwise("-1")
    hint = F.when(F.col("role").isin("assert", "retract", "user"), F.col("role")).otherwise("assert")
    return rows.select("conv_id", "turn", reason.alias("reason"), hint.alias("op_hint"), F.round(C.clamp(raw, F.lit(0.5)), 6).alias("confidence"))


# -- decisions --------------------------------------------------------------------------------------------------------

#: A decision per derived fact: the operation, target and confidence follow from its id.
_DECIDED = (
    "SELECT l.fact_id, l.parent_id, CASE l.fact_id % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'update' WHEN 2 THEN 'retract' WHEN 3 THEN 'noop' ELSE 'merge' END AS op, "
    "CAST((l.fact_id % 20) * 5 AS DOUBLE) / 100 AS confidence FROM v_lineage l"
)
_FINAL = (
    f"SELECT *, CASE WHEN op = 'retract' THEN CASE WHEN parent_id IS NULL OR confidence < {C.RETRACT_MIN} THEN 'noop' ELSE 'retract' END "
    f"WHEN op IN ('update', 'merge') AND parent_id IS NOT NULL AND confidence >= {C.UPDATE_MIN} THEN op WHEN op = 'noop' AND parent_id IS NOT NULL THEN 'noop' "
    f"WHEN confidence < {C.ADD_MIN} THEN 'noop' ELSE 'add' END AS final FROM ({_DECIDED})"
)
_TARGET = "CASE WHEN op = 'retract' OR (final = op AND op IN ('noop', 'update', 'merge')) THEN parent_id END"


def policed(spark, sf_dir):
    rows = views.sql(spark, sf_dir, _DECIDED)
    targets = F.array_compact(F.array("parent_id"))
    return rows.withColumn("p", C.policy(F.col("op"), targets, F.col("confidence"), targets))


@query("policy_gate", f"SELECT fact_id, final AS op, {_TARGET} AS target, CASE WHEN final <> op THEN op END AS proposed FROM ({_FINAL})")
def policy_gate(spark, sf_dir):
    return policed(spark, sf_dir).select("fact_id", "p.op", F.try_element_at("p.targets", F.lit(1)).alias("target"), "p.proposed")


@query(
    "apply_decisions",
    f"WITH d AS (SELECT fact_id, final, {_TARGET} AS target FROM ({_FINAL})) SELECT fact_id AS decided, action, written, target FROM ("
    "SELECT fact_id, 'insert' AS action, fact_id AS written, NULL::BIGINT AS target FROM d WHERE final IN ('add', 'update', 'merge') "
    "UNION ALL SELECT fact_id, 'close', CASE WHEN final = 'retract' THEN target ELSE fact_id END, target FROM d WHERE final IN ('update', 'merge', 'retract') "
    "UNION ALL SELECT fact_id, 'lineage', CASE WHEN final IN ('noop', 'retract') THEN target ELSE fact_id END, CASE WHEN final IN ('update', 'merge') THEN target END FROM d WHERE final <> 'noop' OR target IS NOT NULL)",
)
def apply_decisions(spark, sf_dir):
    """The rows that each decision writes: inserts, closes, lineage."""
    rows = policed(spark, sf_dir).select(F.col("fact_id").alias("decided"), F.explode(C.written(F.col("p.op"), F.col("p.targets"), F.col("fact_id"))).alias("w"))
    return rows.select("decided", "w.action", F.col("w.fact_id").alias("written"), "w.target")


@query(
    "coerce_decision",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'update' WHEN event_id % 4 = 1 THEN 'add' WHEN event_id % 4 = 2 THEN 'merge' ELSE 'add' END AS op, "
    "CASE WHEN event_id % 3 = 0 THEN 1.0 WHEN event_id % 3 = 1 THEN 0.25 ELSE 0.7 END::DOUBLE AS confidence, CASE WHEN event_id % 2 = 0 THEN user_id END AS target FROM events",
)
def coerce_decision(spark, sf_dir):
    """What a model answers, brought into range: operations by name, ids that are numbers, confidence or the candidate's."""
    op = F.element_at(F.array(*map(F.lit, [" UPDATE ", "bogus", "Merge", ""])), (F.col("event_id") % 4 + 1).cast("int"))
    confidence = F.element_at(F.array(*map(F.lit, ["7", "0.25", "sure"])), (F.col("event_id") % 3 + 1).cast("int"))
    target = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("none").try_cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", C.known_op(op).alias("op"), C.clamp(confidence, F.lit(0.7)).alias("confidence"), target.alias("target"))


_SLOT = (
    "SELECT f.fact_id, CASE f.predicate WHEN 'click' THEN 'mag' WHEN 'view' THEN 'status' WHEN 'purchase' THEN 'wohnt_in' ELSE 'hat' END AS predicate, CAST(floor(f.value) % 3 AS BIGINT) AS dst, "
    "p.fact_id AS near_id, CASE WHEN p.fact_id % 4 = 0 THEN 'mag_nicht' WHEN p.predicate = 'click' THEN 'mag' WHEN p.predicate = 'view' THEN 'status' WHEN p.predicate = 'purchase' THEN 'wohnt_in' ELSE 'hat' END AS near_predicate, "
    "CAST(floor(p.value) % 3 AS BIGINT) AS near_dst, 1.0 / (1.0 + abs(f.value - p.value) / 50.0) AS similarity FROM v_facts f JOIN v_lineage l ON f.fact_id = l.fact_id LEFT JOIN v_facts p ON l.parent_id = p.fact_id"
)


def _near(spark, sf_dir):
    rows = views.sql(spark, sf_dir, _SLOT)
    one = F.struct(F.col("near_id").alias("id"), F.col("near_predicate").alias("predicate"), F.lit("s").alias("src"), F.col("near_dst").alias("dst"), F.col("similarity").cast("double").alias("similarity"))
    return rows.withColumn("near", F.when(F.col("near_id").isNotNull(), F.array(one)).otherwise(F.array_remove(F.array(one), one)))


@query(
    "consolidate_decide",
    f"SELECT fact_id, CASE WHEN near_id IS NULL THEN 'add' WHEN near_predicate = predicate AND near_dst = dst THEN 'noop' WHEN predicate = 'mag' AND near_predicate = 'mag_nicht' AND near_dst = dst THEN 'update' "
    f"WHEN near_predicate = predicate AND predicate IN ('status', 'wohnt_in') THEN 'update' ELSE 'add' END AS op FROM ({_SLOT})",
)
def consolidate_decide(spark, sf_dir):
    return _near(spark, sf_dir).select("fact_id", C.propose(F.col("near"), F.col("predicate"), F.lit("s"), F.col("dst"))["op"].alias("op"))


@query("naive_decide", f"SELECT fact_id, CASE WHEN similarity >= 0.55 THEN 'update' ELSE 'add' END AS op, CASE WHEN similarity >= 0.55 THEN near_id END AS target FROM ({_SLOT})")
def naive_decide(spark, sf_dir):
    decided = _near(spark, sf_dir).withColumn("d", C.propose_naive(F.col("near")))
    return decided.select("fact_id", "d.op", F.try_element_at("d.targets", F.lit(1)).alias("target"))


@query(
    "materialise_triples",
    "SELECT name, kind, count(*) AS edges FROM (SELECT 'user ' || subject_id AS name, 'person' AS kind FROM v_facts WHERE status <> 'retracted' UNION ALL SELECT predicate || ' ' || origin_turn, 'event' FROM v_facts WHERE status <> 'retracted') GROUP BY name, kind",
)
def materialise_triples(spark, sf_dir):
    facts = views.facts(spark, sf_dir)
    object_ = F.when(F.col("status") != "retracted", F.concat("predicate", F.lit(" "), F.col("origin_turn").cast("string")))
    rows = facts.select("fact_id", F.concat(F.lit("user "), F.col("subject_id").cast("string")).alias("src"), F.lit("PERSON").alias("src_kind"), "predicate", object_.alias("dst"), F.lit("Event").alias("dst_kind"))
    nodes, edges = C.triples(rows)
    ends = edges.select(F.col("src").alias("name")).union(edges.select("dst"))
    return nodes.join(ends, "name").groupBy("name", "kind").agg(F.count(F.lit(1)).alias("edges"))
