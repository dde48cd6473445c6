"""Steps that bring stored memories to the form that this version reads, each applied once and remembered by checksum.

A step is a Spark SQL expression of the column ``memory``. Steps are only ever added: one that was applied and has another
checksum since is an error.
"""

from __future__ import annotations

import hashlib

_RECEIPTS = """CASE WHEN get_json_object(memory, '$.receipts') IS NULL THEN concat(substr(memory, 1, length(memory) - 1), ', "receipts": []}') ELSE memory END"""
STEPS: dict[str, str] = {"1_receipts": _RECEIPTS}


def checksums(steps: dict[str, str] | None = None) -> dict[str, str]:
    return {name: hashlib.sha256(step.encode()).hexdigest() for name, step in (STEPS if steps is None else steps).items()}


def pending(applied: dict[str, str], steps: dict[str, str] | None = None) -> list[str]:
    """Names of steps to apply, in order."""
    current = checksums(steps)
    changed = [n for n, c in applied.items() if current.get(n, c) != c]
    if changed:
        raise ValueError(f"steps differ from those that were applied: {', '.join(changed)}")
    return [n for n in current if n not in applied]
