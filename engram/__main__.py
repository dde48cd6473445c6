"""A small command line: ``python -m engram STORE ingest turns.json | recall SUBJECT QUERY | facts | export SUBJECT [FILE] | subjects | storage | migrate | receipts | erase SUBJECT [IDS...] | eval``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from engram.evals import suite
from engram.service import Engine
from engram.session import local_session


def main() -> int:
    parser = argparse.ArgumentParser(prog="engram", description=__doc__)
    parser.add_argument("store")
    parser.add_argument("command", choices=("ingest", "recall", "facts", "timeline", "subjects", "storage", "receipts", "migrate", "export", "erase", "replay", "eval"))
    parser.add_argument("args", nargs="*")
    given = parser.parse_args()
    spark = local_session()
    if given.command == "eval":
        found = suite.metrics(suite.run(spark, given.args[0] if given.args else "strict"))
        found.show(truncate=False)
        return int(found.filter("breached").count() > 0)
    engine = Engine(spark, given.store)
    if given.command == "ingest":
        rows = spark.read.json(given.args[0])
        print(engine.ingest(rows.withColumn("occurred_at", rows["occurred_at"].cast("timestamp_ntz"))))
    elif given.command == "recall":
        print(engine.recall(spark.createDataFrame([tuple(given.args[:2])], "subject_id string, query string")).first().text)
    elif given.command == "erase":
        ids = [int(i) for i in given.args[1:]] or None
        print(engine.erase(spark.createDataFrame([(given.args[0], ids)], "subject_id string, fact_ids array<bigint>")))
    elif given.command == "export":
        text = json.dumps(engine.report(given.args[0]), ensure_ascii=False, indent=1)
        if len(given.args) > 1:
            Path(given.args[1]).write_text(text, encoding="utf-8")
        else:
            print(text)
    elif given.command == "migrate":
        print(engine.store.migrate())
    else:
        getattr(engine, given.command)(*given.args).show(100, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
