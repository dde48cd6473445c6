"""Typed keyed state: streams equal batch queries in any order of arrival, over a restart, with repeated rows."""

import random

from pyspark.sql import functions as F

from engram.streaming import typed_state as S


def arrive(spark, rows, schema, folder, batches):
    """Each batch is a file; files come by time of writing."""
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], schema).coalesce(1).write.mode("append").parquet(folder)


def test_versions_equal_a_batch_query_over_a_restart(spark, tmp_path):
    r = random.Random(1)
    rows = [(k % 4, k, r.choice(["a", "b", None]), float(k), r.randint(0, 30)) for k in range(90)]
    r.shuffle(rows)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    read = lambda: spark.readStream.schema(S.FACT).option("maxFilesPerTrigger", 1).parquet(source)
    arrive(spark, rows[:50] + rows[:5], S.FACT, source, 2)
    S.run(S.stream_versions(read()), out, checkpoint)
    arrive(spark, [*rows[50:], (None, 1, "a", 1.0, 1), (9, None, "a", 1.0, 1)], S.FACT, source, 2)
    S.run(S.stream_versions(read()), out, checkpoint)
    got = {(x.subject_id, x.fact_id): (x.predicate, x.value, x.start, x.end, x.successor) for x in S.latest(spark, out, S.VERSION, "subject_id", "fact_id").collect()}
    want = {}
    for subject, fact, predicate, value, start in rows:
        after = sorted((s, f) for q, f, p, _, s in rows if (q, p) == (subject, predicate) and (s, f) > (start, fact))
        want[subject, fact] = (predicate, value, start, *(after[0] if after else (None, None)))
    assert got == want
    assert spark.read.parquet(out).select("batch").distinct().count() == 4


def test_contexts_equal_a_batch_query(spark, tmp_path):
    r = random.Random(2)
    rows = [(k % 2, k % 3, k) for k in range(60)]
    r.shuffle(rows)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    arrive(spark, rows + rows[:4], S.TURN, source, 3)
    S.run(S.stream_contexts(spark.readStream.schema(S.TURN).option("maxFilesPerTrigger", 1).parquet(source)), out, checkpoint)
    got = {x.turn_id: x.context for x in S.latest(spark, out, S.CONTEXT, "subject_id", "session_id", "turn_id").collect()}
    assert got == {t: sorted(u for q, s, u in rows if (q, s) == (a, b) and u < t)[-6:] for a, b, t in rows}


def test_state_is_typed(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    arrive(spark, [(1, 7, "a", 2.5, 3), (1, 8, "a", 3.5, 9)], S.FACT, source, 1)
    S.run(S.stream_versions(spark.readStream.schema(S.FACT).parquet(source)), out, checkpoint)
    with S.state_in_rocksdb(spark):
        state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "facts").load()
        rows = state.select("key.subject_id", F.col("user_map_key.fact_id"), F.col("user_map_value.*")).collect()
    assert sorted(map(tuple, rows)) == [(1, 7, "a", 2.5, 3), (1, 8, "a", 3.5, 9)]


def test_a_state_by_arrivals_gives_the_same_and_grows_by_an_entry_per_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [(k % 2, k, r.choice(["a", "b", None]), r.choice([None, float(k)]), r.randint(0, 30)) for k in range(60)]
    r.shuffle(rows)
    source = str(tmp_path / "in")
    arrive(spark, rows + rows[:5], S.FACT, source, 3)
    found = []
    for processor in (S.Versions, S.ArrivedVersions):
        out, checkpoint = (str(tmp_path / f"{x}-{processor.__name__}") for x in ("out", "state"))
        S.run(S.stream_versions(spark.readStream.schema(S.FACT).option("maxFilesPerTrigger", 1).parquet(source), processor), out, checkpoint)
        found.append({tuple(x) for x in S.latest(spark, out, S.VERSION, "subject_id", "fact_id").collect()})
    assert found[0] == found[1] and len(found[1]) == 60
    with S.state_in_rocksdb(spark):
        entries = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "arrivals").load()
        kept = entries.select("list_element.*").collect()
    assert len(kept) <= 6 and sum(len(x.fact_id) for x in kept) == 60


def test_windows_over_a_stream_leave_out_what_is_too_late(spark, tmp_path):
    import datetime as dt

    from engram.streaming import windows

    at = lambda minute: dt.datetime(2026, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=minute)
    source = str(tmp_path / "in")
    arrivals = [[("a", 0), ("a", 10), ("b", 5), (None, 1)], [("a", 600), ("b", 590)], [("b", 595)], [("a", 20), ("a", 610)], [("c", 2000)], [("c", 2001)]]
    for rows in arrivals:
        spark.createDataFrame([(k, at(m)) for k, m in rows], "subject_id string, occurred_at timestamp").coalesce(1).write.mode("append").parquet(source)
    read = spark.readStream.schema("subject_id string, occurred_at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    query = windows.sessions(read, gap="30 minutes", late="1 hour").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = {(r.subject_id, r.started.timestamp(), r.arrivals) for r in spark.read.parquet(out).collect()}
    t = lambda minute: at(minute).timestamp()
    assert got == {("a", t(0), 2), ("b", t(5), 1), ("a", t(600), 2), ("b", t(590), 2)}  # minute 20 came two batches after minute 600: too late
    whole = windows.sessions(spark.read.parquet(source), gap="30 minutes").collect()
    assert {(r.subject_id, r.started.timestamp(), r.arrivals) for r in whole} == {("a", t(0), 3), ("b", t(5), 1), ("a", t(600), 2), ("b", t(590), 2), ("c", t(2000), 2)}
