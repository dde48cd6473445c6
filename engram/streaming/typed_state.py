"""Streams with typed keyed state: versions of facts under a map state, contexts of turns under a list state.

Rows may arrive in any order and in any split into batches. A subject's map state has one small typed entry per fact
(its slot, value and start) or a list state one typed entry per batch, so a late fact finds its neighbours in the slot
and the facts around it come out anew; a session's list state has its turns' numbers, so a late turn renews the contexts of the few turns after it. What a fact
or a turn came out with last is therefore what a batch query over all rows gives. Nothing is dropped by a watermark, a
row that comes again changes nothing, and a restart goes on from the checkpoint.

State lies in RocksDB per partition; the query sets that provider for itself. Rows with a null key column are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FACT = "subject_id long, fact_id long, predicate string, value double, start long"
VERSION = "subject_id long, fact_id long, predicate string, value double, start long, end long, successor long"
TURN = "subject_id long, session_id long, turn_id long"
CONTEXT = "subject_id long, session_id long, turn_id long, context array<long>"
#: Turns before a turn that belong to its context.
BEFORE = 6
_VERSION = Row("subject_id", "fact_id", "predicate", "value", "start", "end", "successor")
_CONTEXT = Row("subject_id", "session_id", "turn_id", "context")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _renewed(subject: int, known: dict[int, tuple], arriving: Iterator[Row]) -> tuple[list[int], list[Row]]:
    """Facts that are new, which ``known`` (fact: predicate, value, start) then has too, and the versions that they change."""
    new = []
    for row in arriving:
        if row.fact_id not in known:
            known[row.fact_id] = (row.predicate, row.value, row.start)
            new.append(row.fact_id)
    slots: dict[str | None, list[tuple[int, int]]] = defaultdict(list)
    for fact, (predicate, _, start) in known.items():
        slots[predicate].append((start, fact))
    for slot in slots.values():
        slot.sort()
    again = set()
    for fact in new:
        predicate, _, start = known[fact]
        at = bisect_left(slots[predicate], (start, fact))
        again |= {(predicate, k) for k in (at - 1, at) if k >= 0}  # it and the one that it closes
    out = []
    for predicate, k in again:
        slot = slots[predicate]
        (start, fact), after = slot[k], slot[k + 1] if k + 1 < len(slot) else (None, None)
        out.append(_VERSION(subject, fact, predicate, known[fact][1], start, *after))
    return new, out


class Versions(StatefulProcessor):
    """Facts of one subject; each slot's facts follow one another by start and id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getMapState("facts", "fact_id long", "predicate string, value double, start long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        known = {k[0]: tuple(v) for k, v in self.facts.iterator()}
        new, out = _renewed(key[0], known, rows)
        for fact in new:
            self.facts.updateValue((fact,), known[fact])
        yield from out

    def close(self) -> None:
        pass


class ArrivedVersions(StatefulProcessor):
    """The same from a list state with one entry per batch, typed arrays of what it brought: a call per batch, not per fact."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.arrivals = handle.getListState("arrivals", "fact_id array<long>, predicate array<string>, value array<double>, start array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        known = {fact: said for facts, *columns in self.arrivals.get() for fact, *said in zip(facts, *columns, strict=True)}
        new, out = _renewed(key[0], known, rows)
        if new:
            self.arrivals.appendValue((new, *(list(column) for column in zip(*(known[fact] for fact in new), strict=True))))
        yield from out

    def close(self) -> None:
        pass


class Contexts(StatefulProcessor):
    """Turns of one session, by their numbers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        turns = sorted(x[0] for x in self.turns.get())
        new = sorted({row.turn_id for row in rows} - set(turns))
        if new:
            self.turns.appendList([(turn,) for turn in new])
        for turn in new:
            insort(turns, turn)
        places = [bisect_left(turns, turn) for turn in new]
        for k in sorted({k for at in places for k in range(at, min(at + BEFORE + 1, len(turns)))}):
            yield _CONTEXT(key[0], key[1], turns[k], turns[max(0, k - BEFORE) : k])

    def close(self) -> None:
        pass


def stream_versions(facts: DataFrame, processor: type[StatefulProcessor] = Versions) -> DataFrame:
    """What a batch added or changed of ``facts`` (as FACT), each fact with its end and successor as they are now.

    ``ArrivedVersions`` is for streams of many facts, ``Versions`` for a state that is looked into fact by fact.
    """
    rows = facts.filter("subject_id IS NOT NULL AND fact_id IS NOT NULL AND start IS NOT NULL")
    return rows.groupBy("subject_id").transformWithState(processor(), VERSION, "Update", "None")


def stream_contexts(turns: DataFrame) -> DataFrame:
    """The contexts that a batch added or changed of ``turns`` (as TURN)."""
    rows = turns.filter("subject_id IS NOT NULL AND session_id IS NOT NULL AND turn_id IS NOT NULL")
    return rows.groupBy("subject_id", "session_id").transformWithState(Contexts(), CONTEXT, "Update", "None")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that typed state needs, for the queries started within."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def run(stream: DataFrame, out: str, checkpoint: str, seconds: int = 3600) -> None:
    """Process all that has arrived; every batch is a folder under ``out``, written anew if the batch is repeated."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    with state_in_rocksdb(stream.sparkSession):
        query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(seconds)


def latest(spark: SparkSession, out: str, schema: str, *key: str) -> DataFrame:
    """What each key came out with last."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(out)
    kept = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("batch"))))
    return kept.filter("nth = 1").drop("nth", "batch")
