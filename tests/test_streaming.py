"""Streams against their batch twins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from indemna.operators.adjudication import contract_history
from indemna.streaming import events as streams

ROWS = [(1, 1, "2024-01-01 00:00:00", "click"), (2, 1, "2024-01-01 00:29:59", "view"), (3, 1, "2024-01-01 01:00:00", "view"), (4, 2, "2024-01-01 00:10:00", "view"), (5, 1, "2024-01-01 01:31:00", "click"), (6, 9, "2024-01-03 00:00:00", "end")]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "rows")
    spark.createDataFrame(ROWS, "event_id long, user_id long, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp")).repartition(1).write.parquet(path)
    return path


def _all(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_sessions(spark, events, tmp_path):
    batch = streams.sessions(spark.read.parquet(events), "user_id", "ts")
    assert sorted((r.user_id, r.n) for r in batch.collect()) == [(1, 1), (1, 1), (1, 2), (2, 1), (9, 1)]
    stream = spark.readStream.schema(spark.read.parquet(events).schema).parquet(events)
    got = _all(spark, streams.stream_sessions(stream, "user_id", "ts"), "sessions_out", tmp_path)
    assert sorted((r.user_id, r.n) for r in got.collect()) == [(1, 1), (1, 1), (1, 2), (2, 1)]  # the last one is still open


def test_counters(spark, events, tmp_path):
    batch = streams.counters(spark.read.parquet(events), "kind", "ts").where("kind <> 'end'")
    stream = spark.readStream.schema(spark.read.parquet(events).schema).parquet(events)
    got = _all(spark, streams.counters(stream, "kind", "ts"), "counters_out", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_yearly_limits(spark, tmp_path):
    rows = [(1, 2024, "a", "2024-01-01", 10, 1), (1, 2024, "b", "2024-02-01", 5, 0), (1, 2025, "c", "2025-01-01", 7, 1), (2, 2024, "d", "2024-01-01", 3, 0), (1, 2024, "e", "2024-03-01", 1, 1)]
    path = str(tmp_path / "claims")
    spark.createDataFrame(rows, "contract long, year int, claim_id string, ts string, amount long, visit int").write.parquet(path)
    claims = spark.read.parquet(path)
    batch = contract_history(claims, "contract", F.col("year"), ["ts", "claim_id"], "amount", F.col("visit") == 1)
    stream = spark.readStream.schema(claims.schema).parquet(path)
    got = _all(spark, streams.stream_limits(stream), "limits_out", tmp_path)
    assert {(r.claim_id, r.paid_before, r.visits_before) for r in got.collect()} == {(r.claim_id, r.paid_before, r.visits_before) for r in batch.collect()}
    assert not got.where("late").count()


def test_yearly_limits_over_chunks_and_batches(spark, tmp_path):
    """Rows of a key in more than one Arrow chunk are folded in order; what comes after newer rows is told as late."""
    path = str(tmp_path / "claims")
    kind = "contract long, year int, claim_id string, ts string, amount long, visit int"
    write = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    write([(1, 2024, f"c{i:03}", f"2024-03-{28 - i:02}", 1, 0) for i in range(20)])
    chunk = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(chunk)
    try:
        spark.conf.set(chunk, "3")

        def told():
            """One run over what is new; all rows that the runs have given out."""
            out = streams.stream_limits(spark.readStream.schema(kind).parquet(path)).writeStream.format("parquet").outputMode("append")
            out = out.option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            assert out.awaitTermination(120)
            return {r.claim_id: (r.paid_before, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

        first = {f"c{i:03}": (19 - i or None, False) for i in range(20)}
        assert told() == first
        write([(1, 2024, "old", "2024-01-01", 5, 0), (1, 2024, "new", "2024-04-01", 7, 0), (2, 2024, "own", "2024-01-01", 7, 0)])
        assert told() == first | {"old": (20, True), "new": (25, False), "own": (None, False)}
    finally:
        spark.conf.set(chunk, before)


def test_revisions(spark, tmp_path):
    rows = [(1, 1, 5.0, None, False), (1, 2, None, "x", True), (2, 3, None, None, True), (1, 4, 7.0, None, True)]
    path = str(tmp_path / "changes")
    spark.createDataFrame(rows, "user_id long, event_id long, value double, kind string, readjudicated boolean").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    got = _all(spark, streams.stream_revisions(stream, "user_id"), "revisions_out", tmp_path)
    assert sorted(tuple(r) for r in got.where("event_id <> 3").collect()) == [(1, 5.0, None, 0), (2, 5.0, "x", 1), (4, 7.0, "x", 2)]


def test_last_turns(spark):
    rows = spark.range(100).select(F.lit(1).alias("s"), F.col("id").alias("turn"))
    assert sorted(r.turn for r in streams.last_turns(rows, "s", "turn").collect()) == list(range(60, 100))


def test_session_turns(spark, tmp_path):
    """Three runs with late turns, one between two sessions, one before those that are kept; the batch sees all at once."""
    path = str(tmp_path / "turns")
    kind = "event_id long, user_id long, ts timestamp"
    at = lambda m, s=0: f"2024-01-01 {m // 60:02}:{m % 60:02}:{s:02}"
    rows = [
        [(i, 1, at(0, i)) for i in range(50)] + [(100, 1, at(25)), (101, 1, at(62)), (102, 2, at(3)), (103, 2, at(64))],
        [(110, 1, at(60)), (111, 1, at(55)), (112, 2, at(60)), (113, 2, at(60)), (114, 3, at(66))],
        [(120, 1, at(57)), (121, 2, at(200)), (122, 2, at(20))],
        [(130, 9, at(900))],
    ]
    frame = lambda part: spark.createDataFrame(part, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in rows:
        frame(part).coalesce(1).write.mode("append").parquet(path)
        stream = streams.stream_session_turns(spark.readStream.schema(kind).parquet(path), "user_id", "ts", "event_id")
        q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    # Turn 122 is behind the watermark (54 minutes) when it comes; nothing else is lost.
    seen = frame([r for part in rows for r in part if r[0] not in (122, 130)])
    want = {tuple(r) for r in streams.session_turns(seen, "user_id", "ts", "event_id").collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("user_id", "event_id", "ts", "end").collect()} == want
    assert len([x for x in want if x[0] == 1 and x[1] < 50]) == 39
