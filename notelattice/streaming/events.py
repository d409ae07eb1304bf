"""File events and log silence: batch twins and streaming queries that share their functions."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.window import Window as W

DEBOUNCE_MS = 250


def micros(ts: str) -> Column:
    """Microseconds of a timestamp column with or without time zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def debounced(events: DataFrame, quiet_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Of each burst of events on a path (gaps under quiet_ms), the last one: path, kind, fired_at."""
    w = W.partitionBy("path").orderBy("ts", "event_id")
    ms = micros("ts")
    last = events.withColumn("gap", F.lead(ms).over(w) - ms).where(F.col("gap").isNull() | (F.col("gap") >= quiet_ms * 1000))
    return last.select("path", "kind", (F.col("ts") + F.expr(f"interval {quiet_ms} milliseconds")).alias("fired_at"))


def debounced_stream(events: DataFrame, quiet_ms: int = DEBOUNCE_MS, late: str = "10 seconds") -> DataFrame:
    """The same on a stream: a session window per path closes a burst, max_by keeps its last event."""
    window = F.session_window("ts", f"{quiet_ms} milliseconds")
    rows = events.withWatermark("ts", late).groupBy("path", window).agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"))
    return rows.select("path", "kind", F.col("session_window.end").alias("fired_at"))


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path: what a micro-batch acts on."""
    return events.groupBy("path").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("ts"))


def silences(log: DataFrame, seconds: int) -> DataFrame:
    """(vault, since, until) gaps of more than `seconds` between log lines (vault, ts)."""
    w = W.partitionBy("vault").orderBy("ts")
    rows = log.select("vault", F.col("ts").alias("since"), F.lead("ts").over(w).alias("until"))
    return rows.where(micros("until") - micros("since") > seconds * 1_000_000)


def watchdog_state(log: DataFrame, now: str, seconds: int) -> DataFrame:
    """vault, state and stalled at a time: resolving without lines, tailing, or armed and stalled."""
    last = log.groupBy("vault").agg(F.max("ts").alias("last"), F.count("ts").alias("lines"))
    age = F.unix_micros(F.lit(now).cast("timestamp")) - micros("last")
    return last.select("vault", F.when(F.col("lines") == 0, "resolving").when(F.col("lines") == 1, "tailing").otherwise("armed").alias("state"), F.coalesce(age > seconds * 1_000_000, F.lit(False)).alias("stalled"))


def rolling_counts(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """events with `recent`: how many of the key lie in the seconds up to each, itself included."""
    w = W.partitionBy(key).orderBy(micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w))


class Silences(StatefulProcessor):
    """Gaps between the lines of a key. The last line is kept with a timer behind it; the timer tells of a
    silence as soon as event time says that it lasts, a late line only if no timer did."""

    def __init__(self, seconds: int):
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, told boolean, stalls long")

    def _tell(self, key: tuple, at: int, stalls: int) -> pd.DataFrame:
        return pd.DataFrame({"vault": [key[0]], "since": [pd.Timestamp(at, unit="us")], "stalls": [stalls]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, told, stalls = self.last.get() or (None, False, 0)
        times = sorted(int(t) for frame in rows for t in frame["us"])
        for t in times:
            if at is not None and t - at > self.millis * 1000 and not told:
                stalls += 1
                yield self._tell(key, at, stalls)
            if at is None or t > at:
                at, told = t, False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((at, told, stalls))
        if not told:
            # whole milliseconds: the first one that is later than the gap allows
            self.handle.registerTimer(at // 1000 + self.millis + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, told, stalls = self.last.get()
        if not told:
            self.last.update((at, True, stalls + 1))
            yield self._tell(key, at, stalls + 1)

    def close(self) -> None:
        pass


def silence_stream(log: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """vault, since and stalls (the silences of the vault so far) of a stream of (vault, ts), as
    silences() has them, and of silences that still last. Needs the RocksDB state store."""
    rows = log.withWatermark("ts", late).withColumn("us", micros("ts"))
    return rows.groupBy("vault").transformWithStateInPandas(Silences(seconds), "vault string, since timestamp, stalls long", "append", "EventTime")


def index_stream(changes: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Runs apply(upserts, removed paths) for each micro-batch of (kind, path, ...) changes; a path
    comes at most once in a batch."""

    def batch(df: DataFrame, _: int) -> None:
        df = df.persist()
        try:
            if not df.isEmpty():
                apply(df.where("kind = 'upsert'").dropDuplicates(["path"]), df.where("kind = 'remove'").select("path").distinct())
        finally:
            df.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drain(query: StreamingQuery, seconds: float = 30.0) -> bool:
    """Stops a stream once it has done what is there; false if that took too long, and the rest comes
    after a restart. A failure of the stream is raised."""
    done = threading.Thread(target=_finish, args=(query,), daemon=True)
    done.start()
    done.join(seconds)
    late = done.is_alive()
    query.stop()
    if (error := query.exception()) is not None and not late:
        raise error
    return not late


def _finish(query: StreamingQuery) -> None:
    try:
        query.processAllAvailable()
    except Exception:  # drain() asks the query itself
        return
