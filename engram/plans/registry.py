"""Every query of the engine by name, and its oracle."""

from __future__ import annotations

from engram.plans import decisions, governance, streams, temporal, text_retrieval
from engram.plans.temporal import flagship  # noqa: F401

MODULES = (temporal, text_retrieval, decisions, governance, streams)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
