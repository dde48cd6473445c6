"""Settings with their defaults; ``ENGRAM_<NAME>`` in the environment overrides one."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    embedding_dim: int = 1024
    extract_context_turns: int = 6
    consolidate_neighbours: int = 8
    similarity_floor: float = 0.35
    add_min: float = 0.35
    update_min: float = 0.55
    retract_min: float = 0.75
    retrieval_limit: int = 12
    candidates_per_source: int = 24
    rrf_k: int = 60
    graph_hops: int = 2
    injection_token_budget: int = 512
    trace_retention_days: int = 30
    chat_url: str = ""
    embedding_url: str = ""
    model: str = ""

    @staticmethod
    def from_environment(prefix: str = "ENGRAM_") -> Settings:
        given = {f.name: type(f.default)(os.environ[prefix + f.name.upper()]) for f in fields(Settings) if prefix + f.name.upper() in os.environ}
        return replace(Settings(), **given)


#: What this process runs with; set the environment of the driver and the executors alike.
SETTINGS = Settings.from_environment()
