"""Streaming ingest: turns arrive in micro-batches, a subject's memory is keyed state, its facts come out after each batch.

Late turns are accepted, never dropped by a watermark: validity is a column, and what is late is a matter of the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engram.operators.memory import FACTS_SCHEMA, Memory, facts_frame, fold_batches

TURNS_SCHEMA = "subject_id string, session_id string, turn_id long, role string, content string, occurred_at timestamp_ntz"


def stream_facts(turns: DataFrame, provider: str = "strict") -> DataFrame:
    """Facts that a batch added or changed, as they are after it (update mode)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = Memory.from_json(state.get[0]) if state.exists else Memory(str(key[0]), provider, on_late="clamp")
        before, links = [dict(f) for f in memory.facts], len(memory.lineage)
        memory = fold_batches(key, frames, memory)
        state.update((memory.to_json(),))
        changed = {f["id"] for n, f in enumerate(memory.facts) if n >= len(before) or f != before[n]} | {x["fact_id"] for x in memory.lineage[links:]}
        every = facts_frame(memory)
        yield every[every["fact_id"].isin(changed)]

    return turns.groupBy("subject_id").applyInPandasWithState(run, FACTS_SCHEMA, "memory string", "update", GroupStateTimeout.NoTimeout)
