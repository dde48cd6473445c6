"""Stage 1 as a table function over Arrow batches: a turn in, its candidate facts out, as many as it has.

It gives what the column version (``extraction.extract``) gives, in one pass over the sentences instead of one expression
per pattern, and can stand in a FROM clause: over a table, or beside each row by a lateral join. Turns without a user's
statement give no rows; null content has none.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import extraction as E
from engram.operators.memory import candidates, tokens_of

CANDIDATE = "turn_id long, place int, content string, op_hint string, predicate string, object string, object_kind string, confidence double, temporary boolean, valid_from string"
_ARROW = pa.schema([("turn_id", pa.int64()), ("place", pa.int32()), *((c, pa.string()) for c in ("content", "op_hint", "predicate", "object", "object_kind")), ("confidence", pa.float64()), ("temporary", pa.bool_()), ("valid_from", pa.string())])


STEP = "turn_id long, stage string, model string, tokens_in long, tokens_out long, duration_us long, candidates long"
_STEP = pa.schema([("turn_id", pa.int64()), ("stage", pa.string()), ("model", pa.string()), *((c, pa.int64()) for c in ("tokens_in", "tokens_out", "duration_us", "candidates"))])
#: The provider that steps are recorded under.
MODEL = "patterns"


def _rows(turn_id: int, role: str | None, content: str | None, occurred_at: str) -> Iterator[tuple]:
    found = candidates({"content": content, "role": role, "subject_id": "", "occurred_at": occurred_at})
    for place, c in enumerate(found):
        triple = c["triple"] or {}
        predicate = triple.get("predicate")
        yield turn_id, place, c["content"], c["op_hint"], predicate, triple.get("dst"), triple.get("dst_kind"), c["confidence"], predicate in E.TEMPORARY, c["valid_from"][:10]


class _OfTable:
    def eval(self, turns: pa.RecordBatch) -> Iterator[pa.Table]:
        columns = (turns.column(c).to_pylist() for c in ("turn_id", "role", "content", "occurred_at"))
        told = [row for turn in zip(*columns, strict=True) for row in _rows(*turn)]
        yield pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*told, strict=True), _ARROW, strict=True)], schema=_ARROW) if told else _ARROW.empty_table()


class _Traced:
    """What the recorder keeps of stage 1: a step per turn, with its cost."""

    def eval(self, turns: pa.RecordBatch) -> Iterator[pa.Table]:
        steps = []
        for turn in zip(*(turns.column(c).to_pylist() for c in ("turn_id", "role", "content", "occurred_at")), strict=True):
            began = time.perf_counter_ns()
            found = [row[2] for row in _rows(*turn)]
            steps.append((turn[0], "extract", MODEL, tokens_of(turn[2] or ""), sum(map(tokens_of, found)), (time.perf_counter_ns() - began) // 1000, len(found)))
        yield pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*steps, strict=True), _STEP, strict=True)], schema=_STEP) if steps else _STEP.empty_table()


class _OfTurn:
    def eval(self, turn_id: int, role: str, content: str, occurred_at: str) -> Iterator[tuple]:
        yield from _rows(turn_id, role, content, occurred_at)


def extract_table(turns: DataFrame) -> DataFrame:
    """Candidates (CANDIDATE) of ``turns`` (turn_id, role, content, occurred_at), by whole Arrow batches."""
    return F.arrow_udtf(_OfTable, returnType=CANDIDATE)(_told(turns).asTable())


def _told(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("turn_id").cast("long").alias("turn_id"), "role", "content", F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss").alias("occurred_at"))


def extract_steps(turns: DataFrame) -> DataFrame:
    """A trace step (STEP) for every turn: model, tokens in and out (estimated), microseconds, number of candidates."""
    return F.arrow_udtf(_Traced, returnType=STEP)(_told(turns).asTable())


def register(spark: SparkSession, name: str = "candidates") -> None:
    """``SELECT ... FROM turns t, LATERAL candidates(t.turn_id, t.role, t.content, t.occurred_at)``; the time as ISO text.

    Arrow table functions can't stand beside a row in a lateral join (Spark refuses it), so this one is an ordinary one.
    """
    spark.udtf.register(name, F.udtf(_OfTurn, returnType=CANDIDATE))
