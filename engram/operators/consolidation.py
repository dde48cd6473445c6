"""Stage 2 as column expressions: what the model proposes, what the policy lets through, what is written.

A decision is a struct (op, targets, confidence). The policy is pure ``when``; nothing here needs a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.settings import SETTINGS

OPS = ("add", "update", "retract", "noop", "merge")
#: Least confidence of each decision.
ADD_MIN, UPDATE_MIN, RETRACT_MIN = SETTINGS.add_min, SETTINGS.update_min, SETTINGS.retract_min
#: Predicates with one active value, pairs that contradict each other, what counts as the same.
SINGLE_VALUED = ("wohnt_in", "arbeitet_bei", "heisst", "status")
POLARITY = {"mag": "mag_nicht", "mag_nicht": "mag"}
SAME_TEXT, NAIVE_SAME, NAIVE_CONFIDENCE = 0.97, 0.55, 0.9


def clamp(value: Column, otherwise: Column) -> Column:
    """A number in [0, 1]; what isn't a number becomes ``otherwise``."""
    number = value.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan(number), number), otherwise)))


def known_op(op: Column) -> Column:
    return F.when(F.lower(F.trim(op)).isin(*OPS), F.lower(F.trim(op))).otherwise("add")


def policy(op: Column, targets: Column, confidence: Column, seen: Column | None = None) -> Column:
    """Struct (op, targets, proposed): unseen targets go first, then the thresholds. ``proposed`` is null unless overridden."""
    valid = F.array_intersect(targets, seen) if seen is not None else F.array_distinct(targets)
    none = F.array().cast("array<bigint>")
    some = F.size(valid) > 0
    final = (
        F.when((op == "retract") & ~some, "noop")
        .when((op == "retract") & (confidence < RETRACT_MIN), "noop")
        .when(op.isin("update", "merge") & some & (confidence >= UPDATE_MIN), op)
        .when((op == "retract") | ((op == "noop") & some), op)
        .when(some & op.isin("update", "merge"), F.when(confidence < ADD_MIN, "noop").otherwise("add"))
        .otherwise(F.when(confidence < ADD_MIN, "noop").otherwise("add"))
    )
    kept = (
        F.when((op == "retract") & (confidence < RETRACT_MIN), F.slice(valid, 1, 1))
        .when((final == op) & op.isin("retract", "noop", "update", "merge"), valid)
        .otherwise(none)
    )
    return F.struct(final.alias("op"), kept.alias("targets"), F.when(final != op, op).alias("proposed"))


def written(op: Column, targets: Column, fact_id: Column) -> Column:
    """Rows (action, fact_id, target) that a decision writes: inserts, closes and lineage."""
    row = lambda action, fact, target: F.struct(F.lit(action).alias("action"), fact.cast("bigint").alias("fact_id"), target.cast("bigint").alias("target"))
    nothing = F.array().cast("array<struct<action:string,fact_id:bigint,target:bigint>>")
    null = F.lit(None)
    inserted = F.array(row("insert", fact_id, null))
    closed = F.transform(targets, lambda t: row("close", fact_id, t))
    return (
        F.when(op == "noop", F.transform(targets, lambda t: row("lineage", t, null)))
        .when(op == "retract", F.concat(F.transform(targets, lambda t: row("close", t, t)), F.transform(targets, lambda t: row("lineage", t, null))))
        .when(F.size(targets) == 0, F.concat(inserted, F.array(row("lineage", fact_id, null))))
        .when(op.isin("add", "update", "merge"), F.concat(inserted, closed, F.transform(targets, lambda t: row("lineage", fact_id, t))))
        .otherwise(nothing)
    )


def propose(neighbours: Column, predicate: Column, src: Column, dst: Column) -> Column:
    """Struct (op, targets) for a candidate and its open neighbours (id, predicate, src, dst, similarity), values folded.

    An equal one makes it a no-op, then the opposite polarity, then another value of a single-valued slot an update.
    """
    opposite = F.create_map(*[F.lit(x) for pair in POLARITY.items() for x in pair])
    same_src = lambda n: F.coalesce(n["src"], F.lit("")) == F.coalesce(src, F.lit(""))
    slot = lambda n: same_src(n) & (n["predicate"] == predicate)
    ids = lambda keep: F.transform(F.filter(neighbours, lambda n: F.coalesce(keep(n), F.lit(False))), lambda n: n["id"])
    exact = ids(lambda n: (slot(n) & (n["dst"] == dst)) | (predicate.isNull() & n["predicate"].isNull() & (n["similarity"] >= SAME_TEXT)))
    polar = ids(lambda n: same_src(n) & (F.try_element_at(opposite, predicate) == n["predicate"]) & (n["dst"] == dst))
    other = ids(lambda n: slot(n) & predicate.isin(*SINGLE_VALUED) & (n["dst"] != dst))
    decision = lambda op, targets: F.struct(F.lit(op).alias("op"), targets.alias("targets"))
    return (
        F.when(F.size(exact) > 0, decision("noop", F.slice(exact, 1, 1)))
        .when(F.size(polar) > 0, decision("update", polar))
        .when(F.size(other) > 0, decision("update", other))
        .otherwise(decision("add", F.array().cast("array<bigint>")))
    )


def propose_naive(neighbours: Column) -> Column:
    """The baseline: the most similar neighbour of at least 0.55 is updated."""
    near = F.array_sort(F.filter(neighbours, lambda n: n["similarity"] >= NAIVE_SAME), lambda a, b: F.when(a["similarity"] > b["similarity"], -1).when(a["similarity"] < b["similarity"], 1).otherwise((a["id"] - b["id"]).cast("int")))
    found = F.size(near) > 0
    return F.struct(F.when(found, "update").otherwise("add").alias("op"), F.transform(F.slice(near, 1, 1), lambda n: n["id"]).alias("targets"), F.when(found, F.lit(NAIVE_CONFIDENCE)).alias("confidence"))


def triples(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, kind) and edges (src, predicate, dst, fact_id) of facts with a whole triple; kinds are folded in case."""
    whole = facts.filter("src IS NOT NULL AND dst IS NOT NULL AND predicate IS NOT NULL")
    nodes = whole.select(F.col("src").alias("name"), F.lower("src_kind").alias("kind")).union(whole.select("dst", F.lower("dst_kind"))).distinct()
    return nodes, whole.select("src", "predicate", "dst", "fact_id")
