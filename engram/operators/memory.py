"""One subject's memory: the ordered fold of stages 1 and 2, recall (3 and 4) and erasure over its own small state.

Each candidate sees what the candidates before it wrote, so within a subject the work is sequential; subjects are
independent, which is what ``ingest`` and the streaming operator distribute. The state of a subject is about a thousand
facts, so exact vector search over it is fine. Ids count from 1 within a subject; all instants come from the turns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from engram.functions.text import GREETING, HEDGE, fold
from engram.functions.vector import embed_text
from engram.operators import consolidation as C
from engram.operators import extraction as E
from engram.operators.retrieval import BUDGET, HEADER, LIMIT, PER_SOURCE, RRF_K
from engram.settings import SETTINGS

NEIGHBOURS, FLOOR, HOPS, SEEDS = SETTINGS.consolidate_neighbours, SETTINGS.similarity_floor, SETTINGS.graph_hops, 5
#: Vectors that a memory keeps beside its facts, emptied when full.
VECTORS = 4096
ERASED = "(gelöscht)"
_PATTERNS = tuple((re.compile(p, re.IGNORECASE), *rest) for p, *rest in E.PATTERNS)
_REVOCATIONS = tuple(re.compile(p, re.IGNORECASE) for p in E.REVOCATIONS)
_GREETING, _HEDGE = re.compile(rf"^(?:{GREETING})\b", re.IGNORECASE), re.compile(rf"\b(?:{HEDGE})\b", re.IGNORECASE)
_CUT, _END, _WORD = re.compile(r"(?<=[.!?])\s+|\n+"), re.compile(r"[\s.,;:!?]+$"), re.compile(r"\w{2,}")


def tokens_of(text: str) -> int:
    return max(1, (len(text) + 3) // 4)


def matches(needle: str, text: str | None) -> bool:
    if needle.startswith("re:"):
        return re.search(needle[3:], text or "", re.IGNORECASE | re.MULTILINE) is not None
    return needle.casefold() in (text or "").casefold()


def candidates(turn: dict) -> list[dict]:
    """Candidates of a turn, one per sentence at most, in order; a repetition within the turn is left out."""
    found, seen = [], set()
    for sentence in filter(None, (s.strip() for s in _CUT.split(turn["content"] or ""))):
        if turn["role"] != "user" or sentence.endswith("?") or _GREETING.match(sentence):
            continue
        topic = next((t for p in _REVOCATIONS if (m := p.search(sentence)) and (t := _END.sub("", m[1].strip())) and fold(t) not in E.EMPTY_OBJECTS), None)
        if topic is not None:
            predicates = sorted({p for w in re.findall(r"\w+", fold(topic)) for p in E.TOPICS.get(w, ())})
            found.append({"content": E.REVOCATION_TEXT % topic, "confidence": E.REVOKED, "op_hint": "retract", "predicates": predicates, "terms": [topic], "triple": None, "valid_from": turn["occurred_at"]})
            continue
        for pattern, predicate, kind, confidence in _PATTERNS:
            m = pattern.search(sentence)
            said = _END.sub("", m[1].strip()) if m else ""
            if not said or fold(said) in E.EMPTY_OBJECTS or len(said) > E.MAX_OBJECT:
                continue
            content = E.WORDING[predicate] % said
            if fold(content) not in seen:
                seen.add(fold(content))
                sure = round(max(0.1, confidence - E.HEDGED), 2) if _HEDGE.search(sentence) else confidence
                triple = {"src": turn["subject_id"], "predicate": predicate, "dst": said, "dst_kind": kind}
                found.append({"content": content, "confidence": sure, "op_hint": "assert", "predicates": [], "terms": [], "triple": triple, "valid_from": _since(sentence, turn["occurred_at"]) or turn["occurred_at"]})
            break
    return found


def _since(sentence: str, reference: str) -> str | None:
    for pattern in (r"\bseit\s+(?:dem\s+)?(\w+)(?:\s+(\d{4}))?", r"\bsince\s+(\w+)(?:\s+(\d{4}))?"):
        m = re.search(pattern, fold(sentence))
        if not m:
            continue
        if re.fullmatch(r"\d{4}", m[1]):
            return f"{m[1]}-01-01T00:00:00"
        month = E.MONTHS.get(m[1])
        if month:
            year = int(m[2]) if m[2] else int(reference[:4]) - (month > int(reference[5:7]))
            return f"{year:04d}-{month:02d}-01T00:00:00"
    return None


def strict(candidate: dict, near: list[dict]) -> tuple[str, list[int], float]:
    """The default provider: an equal fact, then the opposite polarity, then another value of a single-valued slot."""
    if candidate["op_hint"] == "retract":
        terms = [fold(t) for t in candidate["terms"]]
        hit = sorted(n["id"] for n in near if (n["triple"] or {}).get("predicate") in candidate["predicates"] or any(t and t in fold(n["content"]) for t in terms))
        return ("retract" if hit else "noop"), hit, candidate["confidence"]
    own = candidate["triple"]
    exact, polar, slot = [], [], []
    for n in near:
        other = n["triple"]
        if not other or other["src"] != own["src"]:
            continue
        same = fold(other["dst"]) == fold(own["dst"])
        if other["predicate"] == own["predicate"] and same:
            exact.append(n["id"])
        elif other["predicate"] == own["predicate"] and own["predicate"] in C.SINGLE_VALUED:
            slot.append(n["id"])
        elif C.POLARITY.get(own["predicate"]) == other["predicate"] and same:
            polar.append(n["id"])
    if exact:
        return "noop", exact[:1], candidate["confidence"]
    return ("update", polar or slot, candidate["confidence"]) if polar or slot else ("add", [], candidate["confidence"])


def naive(candidate: dict, near: list[dict]) -> tuple[str, list[int], float]:
    """The baseline: overwrite the most similar fact, whatever it says."""
    best = max(near, key=lambda n: (n["similarity"], n["id"]), default=None)
    return ("update", [best["id"]], C.NAIVE_CONFIDENCE) if best and best["similarity"] >= C.NAIVE_SAME else ("add", [], candidate["confidence"])


PROVIDERS = {"strict": strict, "naive": naive}


def scripted(answers: dict[str, tuple[str, list[int], float]], otherwise: Callable = strict) -> Callable:
    """A provider for tests: what to decide for each candidate by its content."""

    def decide(candidate: dict, near: list[dict]) -> tuple[str, list[int], float]:
        return answers[candidate["content"]] if candidate["content"] in answers else otherwise(candidate, near)

    return decide


def by_model(ask: Callable[[str, str], str], system: str, otherwise: Callable = strict) -> Callable:
    """A provider that asks a model, ``ask(system, user)`` -> JSON text; what can't be used is decided by ``otherwise``."""

    def decide(candidate: dict, near: list[dict]) -> tuple[str, list[int], float]:
        shown = [{"id": n["id"], "content": n["content"], "similarity": round(n["similarity"], 3)} for n in near]
        try:
            said = json.loads(ask(system, json.dumps({"candidate": candidate["content"], "neighbours": shown}, ensure_ascii=False)))
            op = str(said["op"]).strip().lower()
            targets = [int(t) for t in said.get("targets") or []]
            sure = float(said.get("confidence", candidate["confidence"]))
        except (AttributeError, KeyError, TypeError, ValueError):
            return otherwise(candidate, near)
        return (op if op in C.OPS else "add"), targets, min(1.0, max(0.0, sure)) if sure == sure else candidate["confidence"]

    return decide


def police(op: str, targets: list[int], confidence: float, seen: set[int]) -> tuple[str, list[int]]:
    """The policy of stage 2, row by row; the same table as ``consolidation.policy``."""
    targets = [t for t in dict.fromkeys(targets) if t in seen]
    if op == "retract":
        return ("noop", targets[:1]) if not targets or confidence < C.RETRACT_MIN else (op, targets)
    if op == "noop" and targets or op in ("update", "merge") and targets and confidence >= C.UPDATE_MIN:
        return op, targets
    return ("noop", []) if confidence < C.ADD_MIN else ("add", [])


@dataclass
class Memory:
    """What is known of one subject. All instants are ISO texts of one zone, so they compare as text."""

    subject_id: str
    provider: str = "strict"
    dim: int = SETTINGS.embedding_dim
    on_late: str = "raise"
    turns: list[dict] = field(default_factory=list)
    facts: list[dict] = field(default_factory=list)
    lineage: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    steps: list[dict] = field(default_factory=list)
    receipts: list[dict] = field(default_factory=list)

    def use(self, provider: str | Callable) -> Memory:
        """Decide by a provider's name or by a function (candidate, neighbours) -> (op, targets, confidence)."""
        if callable(provider):
            self.provider, self.__dict__["_decide"] = getattr(provider, "__name__", "own"), provider
        else:
            self.provider = provider
            self.__dict__.pop("_decide", None)
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Memory:
        return Memory(**json.loads(text))

    def _vector(self, text: str) -> np.ndarray:
        """A text is embedded once, not once for each candidate that is compared with it."""
        known = self.__dict__.setdefault("_vectors", {})
        if text not in known:
            if len(known) >= VECTORS:
                known.clear()
            known[text] = embed_text(text, self.dim, self.__dict__.setdefault("_buckets", {}))
        return known[text]

    def _open_facts(self) -> list[dict]:
        """What was open when last asked and still is, and newer facts: a closed fact doesn't open again, so it is looked at once."""
        seen, rows = self.__dict__.get("_open", (0, []))
        rows = [f for f in [*rows, *self.facts[seen:]] if f["invalidated_at"] is None and f["status"] != "erased"]
        self.__dict__["_open"] = (len(self.facts), rows)
        return rows

    def _edges_of(self, fact_id: int) -> list[dict]:
        seen, by_fact = self.__dict__.get("_edges", (0, {}))
        for e in self.edges[seen:]:
            by_fact.setdefault(e["fact_id"], []).append(e)
        self.__dict__["_edges"] = (len(self.edges), by_fact)
        return by_fact.get(fact_id, [])

    # -- write path -----------------------------------------------------------------------------------------------

    def ingest(self, turn: dict) -> list[str]:
        """Stages 1 and 2 for a turn (role, content, occurred_at); the operations that were carried out."""
        turn = {"id": len(self.turns) + 1, "subject_id": self.subject_id, "session_id": "", **turn, "redacted": False}
        self.turns.append(turn)
        return [self._consolidate(c, turn) for c in candidates(turn)]

    def _consolidate(self, c: dict, turn: dict) -> str:
        own = self._vector(c["content"])
        near = [{**f, "similarity": float(own @ self._vector(f["content"])), "anchored": False} for f in self._open_facts()]
        near.sort(key=lambda n: (-n["similarity"], n["id"]))
        anchored = sorted((n for n in near if (n["triple"] or {}).get("predicate") in c["predicates"] or any(t.lower() in n["content"].lower() for t in c["terms"])), key=lambda n: -n["id"])[:NEIGHBOURS]
        for n in anchored:
            n["anchored"] = True
        near = [n for n in near[:NEIGHBOURS] if n["similarity"] >= FLOOR or n["anchored"]] + [n for n in near[NEIGHBOURS:] if n["anchored"]]
        proposed, targets, confidence = self.__dict__.get("_decide", PROVIDERS.get(self.provider, strict))(c, near) if near else ("add", [], c["confidence"])
        op, targets = police(proposed, targets, confidence, {n["id"] for n in near})
        self.steps.append({"id": len(self.steps) + 1, "turn_id": turn["id"], "stage": 2, "mentions": [n["id"] for n in near], "text": c["content"], "redacted": False})
        log = lambda fact, parent: self.lineage.append({"fact_id": fact, "parent_id": parent, "op": op, "proposed": proposed if proposed != op else None, "turn_id": turn["id"]})
        if op in ("noop", "retract"):
            for t in targets:
                if op == "retract":
                    self._close(t, "retracted", turn["occurred_at"], turn["occurred_at"])
                log(t, None)
            return op
        fact = {"id": len(self.facts) + 1, "content": c["content"], "status": "active", "valid_from": c["valid_from"], "valid_to": None, "recorded_at": turn["occurred_at"], "invalidated_at": None, "confidence": c["confidence"], "origin_turn": turn["id"], "triple": c["triple"]}
        self.facts.append(fact)
        for t in targets:
            self._close(t, "superseded", turn["occurred_at"], c["valid_from"])
            log(fact["id"], t)
        if not targets:
            log(fact["id"], None)
        if c["triple"]:
            self.edges.append({"src": c["triple"]["src"], "predicate": c["triple"]["predicate"], "dst": c["triple"]["dst"], "fact_id": fact["id"], "valid_from": c["valid_from"], "valid_to": None})
        return op

    def _close(self, fact_id: int, status: str, at: str, valid_to: str) -> None:
        fact = self.facts[fact_id - 1]
        if fact["invalidated_at"] is not None:
            return
        if valid_to < fact["valid_from"]:
            if self.on_late == "raise":
                raise ValueError(f"fact {fact_id} of {self.subject_id} would end before it starts")
            valid_to = fact["valid_from"]
        fact.update(status=status, invalidated_at=at, valid_to=fact["valid_to"] or valid_to)
        for e in self._edges_of(fact_id):
            if e["valid_to"] is None:
                e["valid_to"] = valid_to

    # -- read path ------------------------------------------------------------------------------------------------

    def visible(self, tx: str | None = None, valid: str | None = None) -> list[dict]:
        """The bitemporal predicate."""
        inside = lambda f, a, b, at: f[a] <= at and (f[b] is None or f[b] > at)
        rows = [f for f in self.facts if f["status"] != "erased"]
        if tx is not None:
            rows = [f for f in rows if inside(f, "recorded_at", "invalidated_at", tx)]
        elif valid is not None:
            rows = [f for f in rows if f["status"] != "retracted"]
        else:
            rows = [f for f in rows if f["invalidated_at"] is None]
        return [f for f in rows if valid is None or inside(f, "valid_from", "valid_to", valid)]

    def recall(self, query: str, tx: str | None = None, valid: str | None = None, limit: int | None = None, budget: int | None = None) -> dict:
        """Stages 3 and 4: three ranked sources, fusion, visibility, packing."""
        seen = self.visible(tx, valid)
        asked = self._vector(query) if query.strip() else None
        ranked: dict[str, list[int]] = {"vector": [], "fulltext": [], "graph": []}
        if asked is not None:
            ranked["vector"] = [f["id"] for f in sorted(seen, key=lambda f: (-float(asked @ self._vector(f["content"])), f["id"]))][:PER_SOURCE]
        terms = {t.casefold() for t in _WORD.findall(query)}
        hits = {f["id"]: sum(t.casefold() in terms for t in _WORD.findall(f["content"])) for f in seen}
        ranked["fulltext"] = [i for i, n in sorted(hits.items(), key=lambda x: (-x[1], -x[0])) if n][:PER_SOURCE]
        ranked["graph"] = self._around(terms, asked, tx, valid)[:PER_SOURCE]
        scores: dict[int, float] = {}
        for ids in ranked.values():
            for place, i in enumerate(ids, 1):
                scores[i] = scores.get(i, 0.0) + 1.0 / (RRF_K + place)
        by_id = {f["id"]: f for f in seen}
        best = [i for i, _ in sorted(scores.items(), key=lambda x: (-x[1], x[0])) if i in by_id][: limit or LIMIT]
        lines = {i: f"- {by_id[i]['content']} (seit {by_id[i]['valid_from'][:10]}, Fakt {i})" for i in best}
        used, kept, dropped, most = tokens_of(HEADER), [], [], BUDGET if budget is None else budget
        for i in best:
            (kept if used + tokens_of(lines[i]) <= most else dropped).append(i)
            used += tokens_of(lines[i]) if kept and kept[-1] == i else 0
        text = "\n".join([HEADER, *(lines[i] for i in kept)]) if kept else ""
        self.steps.append({"id": len(self.steps) + 1, "turn_id": None, "stage": 4, "mentions": best, "text": text + "".join(lines[i] for i in dropped), "redacted": False})
        return {"text": text, "included": kept, "dropped": dropped, "tokens_used": used}

    def _around(self, terms: set[str], asked: np.ndarray | None, tx: str | None, valid: str | None) -> list[int]:
        inside = lambda e: valid is None or e["valid_from"] <= valid and (e["valid_to"] is None or e["valid_to"] > valid)
        edges = [e for e in self.edges if (inside(e) if valid is not None else tx is not None or e["valid_to"] is None)]
        names = list(dict.fromkeys(n for e in self.edges for n in (e["src"], e["dst"]) if n != ERASED))
        seeds = [n for n in names if n.lower() in terms]
        if asked is not None:
            seeds += [n for n in sorted(names, key=lambda n: -float(asked @ self._vector(n))) if n not in seeds]
        hop = {n: 0 for n in seeds[:SEEDS]}
        for h in range(1, HOPS + 1):
            for e in edges:
                for a, b in ((e["src"], e["dst"]), (e["dst"], e["src"])):
                    if hop.get(a, h) == h - 1:
                        hop.setdefault(b, h)
        reached: dict[int, int] = {}
        for e in edges:
            near = [hop[n] + 1 for n in (e["src"], e["dst"]) if n in hop]
            if near:
                reached[e["fact_id"]] = min(reached.get(e["fact_id"], 99), *near)
        return [i for i, _ in sorted(reached.items(), key=lambda x: (x[1], x[0]))]

    # -- governance -----------------------------------------------------------------------------------------------

    def preview(self, fact_ids: list[int] | None = None) -> dict[str, list[int]]:
        """What an erasure touches: roots, derived facts, turns, steps. Nothing is changed."""
        alive = {f["id"] for f in self.facts if f["status"] != "erased"}
        roots = sorted(alive if fact_ids is None else alive & set(fact_ids))
        hull, frontier = set(roots), set(roots)
        while frontier:
            frontier = {x["fact_id"] for x in self.lineage if x["parent_id"] in frontier} - hull
            hull |= frontier
        origin = {f["id"]: f["origin_turn"] for f in self.facts}
        about: dict[int, set[int]] = {}
        for i, t in origin.items():
            about.setdefault(t, set()).add(i)
        for x in self.lineage:  # a turn that repeated or revoked a fact speaks of it too
            about.setdefault(x["turn_id"], set()).add(x["fact_id"])
        gone = hull | {f["id"] for f in self.facts if f["status"] == "erased"}
        turns = [t["id"] for t in self.turns if not t["redacted"] and (fact_ids is None or about.get(t["id"], set()) & hull and about[t["id"]] <= gone)]
        steps = [s["id"] for s in self.steps if not s["redacted"] and (fact_ids is None or set(s["mentions"]) & hull or s["turn_id"] in turns or any(origin.get(i) == s["turn_id"] for i in hull))]
        return {"roots": roots, "facts": sorted(hull), "derived": sorted(hull - set(roots)), "turns": turns, "steps": steps}

    def erase(self, fact_ids: list[int] | None = None, reason: str = "") -> dict:
        """Blank facts, turns, steps and names; the receipt has numbers and ids, never texts."""
        plan = self.preview(fact_ids)
        for i in plan["facts"]:
            self.facts[i - 1].update(status="erased", content=ERASED, triple=None)
        for e in self.edges:
            if e["fact_id"] in plan["facts"]:
                e["valid_to"] = e["valid_to"] or self.turns[-1]["occurred_at"]
                e["erased"] = True
        needed = {n for e in self.edges if not e.get("erased") for n in (e["src"], e["dst"])}
        for e in self.edges:
            if e.get("erased"):
                e.update({k: ERASED for k in ("src", "dst") if e[k] not in needed})
        for i in plan["turns"]:
            self.turns[i - 1].update(content=ERASED, redacted=True)
        for i in plan["steps"]:
            self.steps[i - 1].update(text=None, redacted=True)
        receipt = {"id": len(self.receipts) + 1, "scope": "subject" if fact_ids is None else "facts", "reason": reason, **plan}
        self.receipts.append(receipt)
        return {"subject_id": self.subject_id, **receipt}

    def residue(self, needle: str) -> list[str]:
        """Stores in which the needle is still found."""
        stores = {"facts": [f["content"] for f in self.facts] + [json.dumps(f["triple"], ensure_ascii=False) for f in self.facts], "turns": [t["content"] for t in self.turns],
                  "edges": [x for e in self.edges for x in (e["src"], e["dst"])], "steps": [s["text"] for s in self.steps]}
        return [name for name, texts in stores.items() if any(needle.lower() in (t or "").lower() for t in texts)]


# -- over all subjects ------------------------------------------------------------------------------------------------

FACTS_SCHEMA = (
    "subject_id string, fact_id long, content string, status string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, invalidated_at timestamp_ntz, "
    "confidence double, origin_turn long, predicate string, object string, parents array<long>"
)


def facts_frame(memory: Memory) -> pd.DataFrame:
    parents: dict[int, list[int]] = {}
    for x in memory.lineage:
        if x["parent_id"] is not None:
            parents.setdefault(x["fact_id"], []).append(x["parent_id"])
    at = lambda t: datetime.fromisoformat(t) if t else None
    rows = [
        (memory.subject_id, f["id"], f["content"], f["status"], at(f["valid_from"]), at(f["valid_to"]), at(f["recorded_at"]), at(f["invalidated_at"]), f["confidence"], f["origin_turn"],
         (f["triple"] or {}).get("predicate"), (f["triple"] or {}).get("dst"), parents.get(f["id"], []))
        for f in memory.facts
    ]
    names = [c.strip().split(" ")[0] for c in FACTS_SCHEMA.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    for c in ("valid_from", "valid_to", "recorded_at", "invalidated_at"):
        frame[c] = pd.to_datetime(frame[c])
    return frame


def turn_of(row) -> dict:
    return {"session_id": str(row.session_id), "role": row.role, "content": row.content, "occurred_at": pd.Timestamp(row.occurred_at).isoformat()}


def ingest(turns: DataFrame, provider: str | Callable = "strict", on_late: str = "clamp") -> DataFrame:
    """Facts after all turns, folded in order within each subject: ``subject_id, session_id, role, content, occurred_at, turn_id``."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        memory = Memory(str(key[0]), on_late=on_late).use(provider)
        for row in frame.sort_values(["occurred_at", "turn_id"]).itertuples():
            memory.ingest(turn_of(row))
        return facts_frame(memory)

    return turns.groupBy("subject_id").applyInPandas(run, FACTS_SCHEMA)


def fold_batches(key: tuple, frames: Iterator[pd.DataFrame], memory: Memory) -> Memory:
    """New turns of a subject on top of its state, in the order of their instants within the batch."""
    for row in pd.concat(list(frames)).sort_values(["occurred_at", "turn_id"]).itertuples():
        memory.ingest(turn_of(row))
    return memory
