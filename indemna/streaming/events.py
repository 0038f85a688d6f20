"""Sessions, windowed counters and yearly limits: batch functions, and the same on streams.

Streams take event time with a watermark of ten minutes; later rows are dropped and counted by the query's
progress. The stateful ones keep their state in RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

WATERMARK = "10 minutes"
IDLE = "30 minutes"
#: How late a claim may come; totals of a year outlive it by as much.
KEPT_DAYS = 730


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a timestamp with zone, as watermarks need it."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def sessions(events: DataFrame, key: str, ts: str, idle_s: int = 1800) -> DataFrame:
    """(key, start, end, n): runs of events with no gap of ``idle_s`` or more; ``end`` is the last event."""
    w = Window.partitionBy(key).orderBy(ts)
    seconds = F.unix_micros(F.col(ts)) / 1_000_000
    rows = events.withColumn("new", F.coalesce((seconds - F.lag(seconds).over(w) >= idle_s).cast("int"), F.lit(1)))
    rows = rows.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def last_turns(turns: DataFrame, key: str, order: str, n: int = 40) -> DataFrame:
    """The last ``n`` turns of each session."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("back", back).where(F.col("back") <= n).drop("back")


def stream_sessions(events: DataFrame, key: str, ts: str) -> DataFrame:
    """The same on a stream: a session is given out once the watermark has closed it."""
    w = F.session_window(ts, IDLE)
    rows = events.withWatermark(ts, WATERMARK).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.max(ts).alias("end"))
    return rows.select(key, F.col("w.start").alias("start"), "end", "n")


def counters(events: DataFrame, name: str, ts: str, width: str = "1 hour") -> DataFrame:
    """(start, name, n): tumbling counts; on a stream, with the watermark."""
    rows = events.withWatermark(ts, WATERMARK) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), name).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), name, "n")


def in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """All rows of a key in one micro-batch, which arrive in several chunks, sorted together."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable")


class YearlyLimits(StatefulProcessor):
    """What a contract had been paid in a year before each claim; null before its first. A claim that is older than
    one folded in an earlier batch is ``late``: its totals hold the newer ones too. A year's totals go once the
    watermark has passed its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("totals", "paid bigint, visits bigint, ts string, claim_id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        paid, visits, *last = self.state.get() if self.state.exists() else (None, None, None, None)
        out = in_order(rows, "ts", "claim_id")
        before = []
        for ts, claim, amount, visit in zip(out["ts"], out["claim_id"], out["amount"], out["visit"], strict=True):
            late = last[0] is not None and [ts, claim] < last
            before.append((paid, visits, late))
            paid, visits = (paid or 0) + int(amount), (visits or 0) + int(visit)
            last = last if late else [ts, claim]
        told = pd.DataFrame(before, columns=["paid_before", "visits_before", "late"], index=out.index).astype({"paid_before": "Int64", "visits_before": "Int64", "late": "bool"})
        yield out[["claim_id"]].assign(contract=key[0], year=key[1]).join(told)[["contract", "year", "claim_id", "paid_before", "visits_before", "late"]]
        self.state.update((paid, visits, *last))
        self.handle.registerTimer(int(datetime(key[1] + 1, 1, 1, tzinfo=UTC).timestamp() * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_limits(claims: DataFrame) -> DataFrame:
    """``contract_history`` on a stream of (contract, year, claim_id, ts, amount, visit), in order inside a batch, with
    ``late`` for claims that came after newer ones. ``ts`` is a string that sorts by time and reads as a timestamp;
    claims more than ``KEPT_DAYS`` older than the newest are dropped and counted by the query's progress."""
    use_rocksdb(claims.sparkSession)
    timed_ = claims.withColumn("at", F.to_timestamp("ts")).withWatermark("at", f"{KEPT_DAYS} days")
    return timed_.groupBy("contract", "year").transformWithStateInPandas(YearlyLimits(), "contract bigint, year int, claim_id string, paid_before bigint, visits_before bigint, late boolean", "Append", "EventTime")


def session_turns(events: DataFrame, key: str, ts: str, turn: str, n: int = 40, idle_s: int = 1800) -> DataFrame:
    """(key, turn, ts, end): the last ``n`` turns of every session; ``end`` is the last one's time."""
    w = Window.partitionBy(key).orderBy(ts, turn)
    seconds = F.unix_micros(F.col(ts)) / 1_000_000
    rows = events.withColumn("new", F.coalesce((seconds - F.lag(seconds).over(w) >= idle_s).cast("int"), F.lit(1)))
    rows = rows.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    of = Window.partitionBy(key, "session")
    rows = rows.withColumn("end", F.max(ts).over(of)).withColumn("back", F.row_number().over(of.orderBy(F.desc(ts), F.desc(turn))))
    return rows.where(F.col("back") <= n).select(key, turn, ts, "end")


class SessionTurns(StatefulProcessor):
    """The last turns of each open session of a key, given out once the watermark has closed it.

    State is a list of turns with the start of their session. A turn that comes late, but not behind the watermark, joins the
    session that it lies in, or two sessions that it lies between. Of a session only the last ``n`` turns are kept; the start tells how far it reaches back.
    """

    def __init__(self, n: int, idle_ms: int) -> None:
        self.n, self.idle = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "start bigint, ms bigint, turn bigint")

    def _sessions(self) -> list[tuple[int, list[tuple[int, int]]]]:
        held: dict[int, list[tuple[int, int]]] = {}
        for start, ms, turn in self.turns.get() if self.turns.exists() else ():
            held.setdefault(start, []).append((ms, turn))
        return list(held.items())

    def _keep(self, sessions: list[tuple[int, list[tuple[int, int]]]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not sessions:
            self.turns.clear()
            return
        self.turns.put([(start, ms, turn) for start, turns in sessions for ms, turn in turns])
        for end in {turns[-1][0] for _, turns in sessions}:
            self.handle.registerTimer(end + self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(ms), [(int(ms), int(turn))]) for part in rows for ms, turn in zip(part["ms"], part["turn"], strict=True)]
        merged: list[tuple[int, list[tuple[int, int]]]] = []
        for start, turns in sorted([*self._sessions(), *new]):
            if merged and start - merged[-1][1][-1][0] < self.idle:
                first, before = merged.pop()
                merged.append((first, sorted([*before, *turns])[-self.n :]))
            else:
                merged.append((start, sorted(turns)[-self.n :]))
        self._keep(merged)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        sessions = self._sessions()
        self._keep([s for s in sessions if s[1][-1][0] + self.idle > now])
        closed = [(key[0], turn, ms, turns[-1][0]) for _, turns in sessions if turns[-1][0] + self.idle <= now for ms, turn in turns]
        yield pd.DataFrame(closed, columns=["key", "turn", "ms", "end_ms"])

    def close(self) -> None:
        pass


def stream_session_turns(events: DataFrame, key: str, ts: str, turn: str, n: int = 40, idle_s: int = 1800) -> DataFrame:
    """``session_turns`` on a stream, with times cut to milliseconds: turns of a session are given out when it has closed; later ones than the
    watermark are dropped and counted by the query's progress."""
    use_rocksdb(events.sparkSession)
    rows = events.select(F.col(key).cast("long").alias("key"), F.unix_millis(F.col(ts)).alias("ms"), F.col(turn).cast("long").alias("turn"), F.col(ts).alias("at")).withWatermark("at", WATERMARK)
    out = rows.groupBy("key").transformWithStateInPandas(SessionTurns(n, idle_s * 1000), "key bigint, turn bigint, ms bigint, end_ms bigint", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.col("turn").alias(turn), F.timestamp_millis("ms").alias(ts), F.timestamp_millis("end_ms").alias("end"))


class Revisions(StatefulProcessor):
    """Folds partial updates of a claim; an idle session's state expires and isn't revived."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("claim", "value double, kind string, revision bigint", 30 * 60 * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, kind, revision = self.state.get() if self.state.exists() else (None, None, 0)
        out = []
        for r in in_order(rows, "event_id").itertuples():
            value = value if pd.isna(r.value) else float(r.value)
            kind = kind if pd.isna(r.kind) else r.kind
            revision += int(r.readjudicated)
            out.append((r.event_id, value, kind, revision))
        yield pd.DataFrame(out, columns=["event_id", "value", "kind", "revision"])
        self.state.update((value, kind, revision))

    def close(self) -> None:
        pass


def stream_revisions(changes: DataFrame, key: str) -> DataFrame:
    """``revise`` on a stream of (key, event_id, value, kind, readjudicated)."""
    use_rocksdb(changes.sparkSession)
    return changes.groupBy(key).transformWithStateInPandas(Revisions(), "event_id bigint, value double, kind string, revision bigint", "Append", "ProcessingTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def trace_totals(spans: DataFrame, trace: str, depth: str, ms: str) -> DataFrame:
    """(trace, spans, total_ms, failed): the total counts spans of depth 0 only."""
    return spans.groupBy(trace).agg(F.count("*").alias("spans"), F.round(F.sum(F.when(F.col(depth) == 0, F.col(ms)).otherwise(0.0)), 2).alias("total_ms"), F.count_if(~F.col("ok")).alias("failed"))
