"""The bitemporal predicate: validity [valid_from, valid_to) and transaction [recorded_at, invalidated_at), both half open.

Erased facts are invisible at every instant. Without an instant a fact is visible while it isn't invalidated. At a
transaction time today's status doesn't matter. At a valid time a superseded fact counts, a retracted one never does.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def _instant(at: datetime | str) -> Column:
    return F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else F.lit(at)


def within(start: str, end: str, at: datetime | str) -> Column:
    return (F.col(start) <= _instant(at)) & (F.col(end).isNull() | (F.col(end) > _instant(at)))


def as_of(tx: datetime | str | None = None, valid: datetime | str | None = None, status: str = "status") -> Column:
    """Visible facts: now, at a transaction time, at a valid time, or both."""
    seen = F.col(status) != "erased"
    if tx is not None:
        seen = seen & within("recorded_at", "invalidated_at", tx)
    elif valid is not None:
        seen = seen & (F.col(status) != "retracted")
    else:
        seen = seen & F.col("invalidated_at").isNull()
    return seen & within("valid_from", "valid_to", valid) if valid is not None else seen


def edges_at(valid: datetime | str | None = None, only_open: bool = True) -> Column:
    """Edges carry validity only: at an instant, the open ones, or all."""
    if valid is not None:
        return within("valid_from", "valid_to", valid)
    return F.col("valid_to").isNull() if only_open else F.lit(True)
