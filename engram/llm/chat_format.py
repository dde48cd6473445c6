r"""Chat formatting: a finite-state machine over roles checks the order of turns, a declarative template marks them.

Each turn becomes three segments - head, text, end - with a loss flag each; a conversation's output is their
concatenation. Control strings that occur inside a role or a text are escaped: every backslash is doubled, then a
backslash is put after the first character of each control string, so no control string is left in it and
``unescape`` gets the very text back (each backslash is dropped and the character after it stays).

Only built-in functions run. A conversation is one training example, so its turns meet in one row; what is done per
turn (escaping) is done before they meet. ``turns`` gives the same segments as one row per turn where a consumer
streams them.

Defined cases: null text and null role are empty; an empty or unknown role is formatted like any other, without loss,
and makes the conversation invalid. Equal turn numbers are ordered by role, then text; a null turn comes first;
repeated rows are turns of their own. A very long text is one value of its row, and a conversation's output one string, so
both must fit a row. A null conv_id is a conversation like any other. No rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import table


@dataclass(frozen=True)
class Template:
    """``head`` role ``middle`` text ``end``; ``loss`` names the roles whose text is trained on."""

    head: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    others: tuple[str, ...] = ("</s>", "<s>", "[INST]", "[/INST]", "<|endoftext|>")
    loss: tuple[str, ...] = ("assistant",)
    #: state -> roles that may follow; a state is the last role, "" the start.
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.head, self.middle, self.end, *self.others)


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), template.controls, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per turn: ``conv_id, turn, role, text, segments``; segments are (kind, text, loss), escaped."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    parts = F.array(
        F.struct(F.lit("head").alias("kind"), F.concat(F.lit(template.head), escape(F.col("role"), template), F.lit(template.middle)).alias("text"), F.lit(False).alias("loss")),
        F.struct(F.lit("text").alias("kind"), escape(F.col("text"), template).alias("text"), F.col("role").isin(*template.loss).alias("loss")),
        F.struct(F.lit("end").alias("kind"), F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
    )
    return rows.withColumn("segments", parts)


def _first_bad_turn(roles: Column, template: Template) -> Column:
    """Number (from 0) of the first turn that the machine refuses; the number of turns if only the end is not final; else -1."""
    allowed = F.create_map(*[F.lit(x) for s, follow in template.order.items() for x in (s, "\x00".join(("", *follow, "")))])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(-1).alias("bad"))

    def step(acc: Column, role: Column) -> Column:
        fine = F.coalesce(F.contains(F.try_element_at(allowed, acc["state"]), F.concat(F.lit("\x00"), role, F.lit("\x00"))), F.lit(False)) & (role != "")
        return F.struct(role.alias("state"), (acc["n"] + 1).alias("n"), F.when((acc["bad"] < 0) & ~fine, acc["n"]).otherwise(acc["bad"]).alias("bad"))

    return F.aggregate(roles, start, step, lambda a: F.when((a["bad"] < 0) & ~a["state"].isin(*template.final), a["n"]).otherwise(a["bad"]))


def format_conversations(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, segments, valid, first_bad_turn``."""
    rows = turns(conversations, template)
    met = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "segments"))).alias("all"))
    segments = F.flatten(F.transform("all", lambda t: t["segments"]))
    bad = _first_bad_turn(F.transform("all", lambda t: t["role"]), template)
    out = met.select("conv_id", segments.alias("segments"), bad.alias("first_bad_turn"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", (F.col("first_bad_turn") < 0).alias("valid"), "first_bad_turn")


def parse(formatted: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped. No control string is left inside them."""
    marked = F.split(formatted, _quoted(template.head), -1)
    pieces = F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        halves = F.split(piece, _quoted(template.middle), 2)
        text = F.substring(halves[1], F.lit(1), F.length(halves[1]) - len(template.end))
        return F.struct(unescape(halves[0]).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def _quoted(control: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in control)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = F.expr("inline(array(struct(-7L, 0L, 'user', '</s>[INST] ok [/INST]'), struct(-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')))")
    planted = spark.range(1).select(both.alias("conv_id", "turn", "role", "text"))
    out = format_conversations(conversations.union(planted))
    read = out.withColumn("turns", parse(F.col("formatted"))).withColumn("trained", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_bad_turn",
    )


def _oracle(template: Template) -> str:
    def escaped(x: str) -> str:
        return reduce(lambda a, c: f"replace({a}, '{c}', '{c[0]}\\{c[1:]}')", template.controls, f"replace({x}, '\\', '\\\\')")

    marks = len(template.head) + len(template.middle) + len(template.end)
    allowed = " OR ".join(f"(before = '{s}' AND role IN ({', '.join(repr(r) for r in follow)}))" for s, follow in template.order.items())
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER w - 1 AS n, coalesce(lag(role) OVER w, '') AS before FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY n) FILTER (role IN ({', '.join(repr(r) for r in template.loss)})), '') AS trained,
  sum({marks} + length({escaped('role')}) + length({escaped('text')}))::BIGINT AS formatted_chars,
  min(n) FILTER (NOT ({allowed})) AS bad, max_by(role, n) AS last FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(trained)::BIGINT AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars,
  bad IS NULL AND last IN ({', '.join(repr(r) for r in template.final)}) AS valid,
  CASE WHEN bad IS NOT NULL THEN bad WHEN last NOT IN ({', '.join(repr(r) for r in template.final)}) THEN n_turns ELSE -1 END::INTEGER AS first_bad_turn
FROM g
"""


ORACLE_SQL = _oracle(CHAT)
