"""The evaluation suite: scenarios run turn by turn, probes at checkpoints, residue after erasures, metrics over all.

A scenario is a row, so a suite is a DataFrame and scenarios run in parallel; an error in one is its own probe.
"""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators.memory import Memory, matches

SCENARIOS = Path(__file__).with_name("stories.json")
#: Bounds of a passing suite; the second and third are upper bounds.
THRESHOLDS = {"update_recall": 0.90, "stale": 0.10, "false_retraction": 0.05, "erasure": 1.0}
PROBES = "scenario string, pattern string, checkpoint string, kind string, needle string, outcome string"


def load(path: str | Path = SCENARIOS, only: str = "") -> list[dict]:
    """Scenarios whose id contains ``only``: of a JSON list, or of a folder with one YAML mapping per file, by name."""
    path = Path(path)
    if not path.is_dir():
        return [s for s in json.loads(path.read_text(encoding="utf-8")) if only in s["id"]]
    import yaml

    found = [_of_yaml(file.stem, yaml.safe_load(file.read_text(encoding="utf-8"))) for file in sorted(path.glob("*.yaml"))]
    return [s for s in found if only in s["id"]]


def _of_yaml(stem: str, raw: dict) -> dict:
    erasures = raw.get("erasure") or []
    checks = [
        {"after": c["after"], "query": c["query"], "present": c.get("expect_present", []), "absent": c.get("expect_absent", []), "active": c.get("must_stay_active", [])}
        for c in raw.get("checkpoints", [])
    ]
    return {
        "id": raw.get("id", stem), "pattern": raw.get("pattern", ""), "turns": [[str(t["at"])[:10], t["text"]] for t in raw.get("turns", [])], "checkpoints": checks,
        "erasures": [{"after": e["after"], "matching": e.get("facts_matching"), "residue": e.get("residue", [])} for e in (erasures if isinstance(erasures, list) else [erasures])],
        "preconditions": raw.get("preconditions", []),
    }


def probes_of(scenario: dict, provider: str = "strict") -> list[tuple[str, str, str, str]]:
    """(checkpoint, kind, needle, outcome) of every probe of a scenario."""
    memory, out = Memory(f"eval:{scenario['id']}", provider), []
    stored = lambda needle: [f for f in memory.facts if matches(needle, f["content"])]
    for n, (day, said) in enumerate(scenario["turns"], 1):
        memory.ingest({"role": "user", "content": said, "occurred_at": f"{day}T00:00:00"})
        for c in (c for c in scenario.get("checkpoints", []) if c["after"] == n):
            text = memory.recall(c["query"])["text"]
            out += [(f"after {n}", "update_recall", x, "pass" if matches(x, text) else "fail") for x in c.get("present", [])]
            out += [(f"after {n}", "stale", x, "fail" if matches(x, text) else "pass" if stored(x) else "unsupported") for x in c.get("absent", [])]
            for x in c.get("active", []):
                states = {f["status"] for f in stored(x)}
                out.append((f"after {n}", "false_retraction", x, "unsupported" if not states else "pass" if "active" in states else "fail"))
        for e in (e for e in scenario.get("erasures", []) if e["after"] == n):
            ids = [f["id"] for f in stored(e["matching"])] if e.get("matching") else None
            memory.erase(ids, "evaluation")
            out += [(f"erasure after {n}", "erasure", x, "fail" if memory.residue(x) else "pass") for x in e["residue"]]
    out += [("end", "precondition", x, "pass" if stored(x) else "fail") for x in scenario.get("preconditions", [])]
    return out


def run(spark: SparkSession, provider: str = "strict", scenarios: list[dict] | None = None) -> DataFrame:
    """Probes of all scenarios."""
    rows = [(s["id"], s["pattern"], json.dumps(s, ensure_ascii=False)) for s in (load() if scenarios is None else scenarios)]

    def play(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        row = frame.iloc[0]
        try:
            found = probes_of(json.loads(row["body"]), provider)
        except Exception as problem:  # noqa: BLE001  one scenario's failure is a finding of its own
            found = [("run", "error", str(problem)[:200], "fail")]
        return pd.DataFrame([(key[0], row["pattern"], *p) for p in found], columns=[c.split(" ")[0] for c in PROBES.split(", ")])

    return spark.createDataFrame(rows, "id string, pattern string, body string").groupBy("id").applyInPandas(play, PROBES)


def metrics(probes: DataFrame) -> DataFrame:
    """``kind, passed, failed, unsupported, rate, breached``: two rates count passes, two failures; no basis, no vote."""
    count = lambda outcome: F.sum((F.col("outcome") == outcome).cast("int")).cast("long").alias(outcome)
    by = probes.filter(F.col("kind").isin(*THRESHOLDS)).groupBy("kind").agg(count("pass"), count("fail"), count("unsupported"))
    upper = F.col("kind").isin("stale", "false_retraction")
    rate = F.try_divide(F.when(upper, F.col("fail")).otherwise(F.col("pass")).cast("double"), F.col("pass") + F.col("fail"))
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair]), F.col("kind"))
    breached = F.coalesce(F.when(upper, rate > bound).otherwise(rate < bound), F.lit(False))
    return by.select("kind", F.col("pass").alias("passed"), F.col("fail").alias("failed"), "unsupported", rate.alias("rate"), breached.alias("breached"))
