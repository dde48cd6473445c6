"""Prompt templates: two marked parts in a text file, a reference that names the very text, filling by name."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from pathlib import Path

_PARTS = re.compile(r"^--- (system|user) ---\s*$", re.MULTILINE)
_FIELD = re.compile(r"\{\{(\w+)\}\}")


@dataclass(frozen=True)
class Prompt:
    system: str
    user: str
    ref: str

    @staticmethod
    def read(path: str | Path) -> Prompt:
        raw = Path(path).read_text(encoding="utf-8")
        pieces = _PARTS.split(raw)
        parts = dict(zip(pieces[1::2], (p.strip() for p in pieces[2::2]), strict=True))
        if set(parts) != {"system", "user"}:
            raise ValueError(f"{path} needs a system and a user part")
        return Prompt(parts["system"], parts["user"], f"{Path(path).stem}@{hashlib.sha256(raw.encode()).hexdigest()[:12]}")

    def fill(self, **values: object) -> tuple[str, str]:
        """System and user text; a field without a value is a KeyError."""
        return tuple(_FIELD.sub(lambda m: str(values[m[1]]), part) for part in (self.system, self.user))
