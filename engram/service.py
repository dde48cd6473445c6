"""The engine's Python API over a store: ingest, recall, history, graph, erasure, export, replay, retention.

Every call is one plan over all subjects that it is given; subjects are independent, so work is dealt by subject.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators.memory import FACTS_SCHEMA, Memory, facts_frame, turn_of
from engram.sources.store import Store

REPLAYED = "replay:"
#: Most rows of each list in a report; parts of a memory.
CAPS = {"facts": 10_000, "turns": 10_000, "receipts": 1_000}
PARTS = ("turns", "facts", "lineage", "edges", "steps", "receipts")
_RECALL = "subject_id string, query string, tx string, valid string, text string, included array<long>, dropped array<long>, tokens_used long, memory string"


class Engine:
    def __init__(self, spark: SparkSession, root: str, provider: str | Callable = "strict", on_late: str = "raise"):
        self.spark, self.store, self.provider, self.on_late = spark, Store(spark, root), provider, on_late

    # -- write path -----------------------------------------------------------------------------------------------

    def ingest(self, turns: DataFrame) -> int:
        """Turns (subject_id, session_id, turn_id, role, content, occurred_at) on top of what is stored; the new version."""
        provider, on_late = self.provider, self.on_late

        def run(key: tuple, new: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            memory = (Memory.from_json(stored["memory"].iat[0]) if len(stored) else Memory(str(key[0]), on_late=on_late)).use(provider)
            for row in new.sort_values(["occurred_at", "turn_id"]).itertuples():
                memory.ingest(turn_of(row))
            return pd.DataFrame({"subject_id": [memory.subject_id], "memory": [_dump(memory)]})

        new = turns.select(F.col("subject_id").cast("string").alias("subject_id"), "session_id", "turn_id", "role", "content", "occurred_at")
        known = self.store.read().join(new.select("subject_id").distinct(), "subject_id", "left_semi").select("subject_id", "memory")
        return self.store.commit(new.groupBy("subject_id").cogroup(known.groupBy("subject_id")).applyInPandas(run, "subject_id string, memory string"))

    def _each(self, run: Callable[[Memory, pd.Series], dict], asked: DataFrame, schema: str) -> DataFrame:
        """``run`` for every row of ``asked`` on the memory of its subject."""

        def play(frames):
            for frame in frames:
                yield pd.DataFrame([run(Memory.from_json(row["memory"]), row) for _, row in frame.iterrows()], columns=[c.strip().split(" ")[0] for c in schema.split(", ")])

        return asked.join(self.store.read().select("subject_id", "memory"), "subject_id").mapInPandas(play, schema)

    # -- read path ------------------------------------------------------------------------------------------------

    def recall(self, questions: DataFrame, limit: int | None = None, budget: int | None = None, record: bool = False) -> DataFrame:
        """Questions (subject_id, query and, where asked, tx and valid as ISO texts) to contexts; ``record`` stores the trace."""

        def run(memory: Memory, row: pd.Series) -> dict:
            found = memory.recall(row["query"] or "", row.get("tx"), row.get("valid"), limit, budget)
            return {"subject_id": memory.subject_id, "query": row["query"], "tx": row.get("tx"), "valid": row.get("valid"), **found, "memory": _dump(memory)}

        out = self._each(run, questions, _RECALL)
        if record:
            out = out.persist()
            self.store.commit(out.groupBy("subject_id").agg(F.max("memory").alias("memory")))
        return out.drop("memory")

    def facts(self, subject: str | None = None) -> DataFrame:
        """All facts of all subjects or of one, whatever their status; the columns that ``as_of`` asks for."""

        def rows(frames):
            for frame in frames:
                for text in frame["memory"]:
                    yield facts_frame(Memory.from_json(text))

        return self.store.read_subject(subject).select("memory").mapInPandas(rows, FACTS_SCHEMA)

    def _parts(self, name: str, schema: str, subject: str | None = None) -> DataFrame:
        """One of the state's lists as rows, parsed by Spark; of one subject, only its bucket is read."""
        item = f"array<struct<{schema}>>"
        parsed = F.from_json(F.get_json_object("memory", f"$.{name}"), item)
        return self.store.read_subject(subject).select("subject_id", F.explode(parsed).alias("x")).select("subject_id", "x.*")

    def turns(self, subject: str | None = None) -> DataFrame:
        return self._parts("turns", "id:bigint,session_id:string,role:string,content:string,occurred_at:string,redacted:boolean", subject)

    def lineage(self, subject: str | None = None) -> DataFrame:
        return self._parts("lineage", "fact_id:bigint,parent_id:bigint,op:string,proposed:string,turn_id:bigint", subject)

    def graph(self, subject: str | None = None) -> DataFrame:
        return self._parts("edges", "src:string,predicate:string,dst:string,fact_id:bigint,valid_from:string,valid_to:string", subject)

    def timeline(self) -> DataFrame:
        """Operations per turn."""
        return self.lineage().groupBy("subject_id", "turn_id", "op").agg(F.count(F.lit(1)).alias("changes"))

    def receipts(self, subject: str | None = None) -> DataFrame:
        """Erasures that were carried out: numbers and ids, never texts."""
        return self._parts("receipts", "id:bigint,scope:string,reason:string,facts:array<bigint>,turns:array<bigint>,steps:array<bigint>", subject)

    def export(self, subject: str) -> DataFrame:
        """Facts that aren't erased, with the turn that they come from and their history: own entries, and what took
        their place. Only lineage of delivered facts is grouped."""
        origin = self.turns(subject).select("subject_id", F.col("id").alias("origin_turn"), F.when(F.col("redacted"), "(gelöscht)").otherwise(F.col("content")).alias("source"))
        own = self.facts(subject).filter("status <> 'erased'")
        lineage = self.lineage(subject)
        entry = [F.col("turn_id"), F.col("fact_id").alias("by_fact")]
        of_fact = lineage.select(F.col("fact_id").alias("about"), F.struct(*entry, F.col("op").alias("note")).alias("entry"))
        of_parent = lineage.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("about"), F.struct(*entry, F.lit("superseded").alias("note")).alias("entry"))
        delivered = of_fact.union(of_parent).join(own.select(F.col("fact_id").alias("about")), "about", "left_semi")
        history = delivered.groupBy(F.col("about").alias("fact_id")).agg(F.array_sort(F.collect_list("entry")).alias("history"))
        return own.join(origin, ["subject_id", "origin_turn"], "left").join(history, "fact_id", "left")

    def report(self, subject: str, caps: dict[str, int] | None = None) -> dict:
        """All that is stored of a subject, as a JSON document: facts with history, turns, receipts; each list up to its
        cap, which ``truncated`` names if there is more. ``export``, ``turns`` and ``receipts`` have all rows."""
        caps, out, truncated = CAPS | (caps or {}), {}, []
        turns = self.turns(subject).withColumn("content", F.when(F.col("redacted"), "(gelöscht)").otherwise(F.col("content")))
        for name, rows, by in (("facts", self.export(subject), "fact_id"), ("turns", turns, "id"), ("receipts", self.receipts(subject), "id")):
            found = rows.orderBy(by).limit(caps[name] + 1).toJSON().collect()  # at most cap + 1
            truncated += [name] if len(found) > caps[name] else []
            out[name] = [json.loads(x) for x in found[: caps[name]]]
        return {"subject_id": subject, "complete": not truncated, "truncated": truncated, **out}

    def write_exports(self, path: str) -> None:
        """An export of every subject as JSON files under ``path``, a document per line: facts, turns and receipts. It is written by the
        tasks that have the subjects; ``report`` is the same of one subject with caps."""
        facts, turns = self.facts().filter("status <> 'erased'"), self.turns().withColumn("content", F.when(F.col("redacted"), "(gelöscht)").otherwise(F.col("content")))
        whole = self.store.read().select("subject_id")
        for name, rows, by in (("facts", facts, "fact_id"), ("turns", turns, "id"), ("receipts", self.receipts(), "id")):
            listed = rows.select("subject_id", F.struct(by, *[c for c in rows.columns if c not in ("subject_id", by)]).alias("x")).groupBy("subject_id").agg(F.sort_array(F.collect_list("x")).alias(name))
            whole = whole.join(listed, "subject_id", "left")
        whole.write.mode("overwrite").json(path)

    def subjects(self) -> DataFrame:
        """Active facts and the last instant per subject."""
        active = self.facts().filter("status = 'active'").groupBy("subject_id").agg(F.count(F.lit(1)).alias("facts"))
        last = self.turns().groupBy("subject_id").agg(F.count(F.lit(1)).alias("turns"), F.max("occurred_at").alias("last_turn"))
        return last.join(active, "subject_id", "left").fillna(0, ["facts"])

    def storage(self) -> DataFrame:
        """Rows and bytes of each part of the store, largest first."""
        parts = [F.struct(F.lit(p).alias("part"), F.get_json_object("memory", f"$.{p}").alias("x")) for p in PARTS]
        rows = self.store.read().select(F.explode(F.array(*parts)).alias("p")).select("p.part", "p.x")
        sums = F.coalesce(F.sum(F.json_array_length("x")), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.octet_length("x")), F.lit(0)).alias("bytes")
        return rows.groupBy("part").agg(*sums).orderBy(F.desc("bytes"), "part")

    # -- governance -----------------------------------------------------------------------------------------------

    def preview(self, requests: DataFrame) -> DataFrame:
        """Requests (subject_id, fact_ids: null for the whole subject) to what an erasure would touch."""
        return self._each(lambda memory, row: {"subject_id": memory.subject_id, "plan": json.dumps(memory.preview(_ids(row)))}, requests, "subject_id string, plan string")

    def erase(self, requests: DataFrame, reason: str = "") -> list[dict]:
        """Erase, commit and delete older versions of the data; a receipt per request."""

        def run(memory: Memory, row: pd.Series) -> dict:
            receipt = memory.erase(_ids(row), reason)
            return {"subject_id": memory.subject_id, "receipt": json.dumps(receipt), "memory": _dump(memory)}

        done = self._each(run, requests, "subject_id string, receipt string, memory string").persist()
        self.store.commit(done.select("subject_id", "memory"))
        receipts = [json.loads(r.receipt) for r in done.select("receipt").collect()]
        done.unpersist()
        self.store.vacuum()
        return receipts

    def replay(self, subject: str) -> DataFrame:
        """Ingest the turns of a subject anew, in the order of their instants, and compare the active facts: ``said, side``."""
        turns = self.turns(subject).filter(~F.col("redacted"))
        target = f"{REPLAYED}{subject}"
        self.ingest(turns.select(F.lit(target).alias("subject_id"), "session_id", F.col("id").alias("turn_id"), "role", "content", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at")))
        active = lambda s: self.facts(s).filter("status = 'active'").select(F.lower("content").alias("said")).distinct()
        one, other = (active(s).withColumn(n, F.lit(True)) for s, n in ((subject, "original"), (target, "replay")))
        side = F.when(F.col("replay").isNull(), "only_original").when(F.col("original").isNull(), "only_replay").otherwise("unchanged")
        return one.join(other, "said", "full_outer").select("said", side.alias("side"))

    def purge(self, subject: str) -> None:
        """Remove a replayed or evaluated subject, and nothing else."""
        if not subject.startswith((REPLAYED, "eval:")):
            raise ValueError("only replayed and evaluated subjects are purged")
        self.store.commit(self.spark.createDataFrame([(subject, None)], "subject_id string, memory string"))
        self.store.vacuum()

    def prune_traces(self, before: str) -> None:
        """Blank the texts of steps of turns before an instant; lineage stays."""

        def run(memory: Memory, row: pd.Series) -> dict:
            old = {t["id"] for t in memory.turns if t["occurred_at"] < before}
            for s in memory.steps:
                if s["turn_id"] in old:
                    s.update(text=None, redacted=True)
            return {"subject_id": memory.subject_id, "memory": _dump(memory)}

        self.store.commit(self._each(run, self.store.read().select("subject_id"), "subject_id string, memory string"))


def _dump(memory: Memory) -> str:
    return memory.to_json()


def _ids(row: pd.Series) -> list[int] | None:
    ids = row.get("fact_ids")
    return None if ids is None else [int(i) for i in ids]
