"""Sessions of activity by keyed timers (problem 5), for batches and for streams.

One state machine serves both: an ordered event extends the open session of its key and
sets the timer to the latest end plus the gap; an event after the timer, or the expiry of
the timer, emits the final session.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.storage import scratch

GAP_MS = 1_800_000
#: Width of the slices that a key is cut into, so that no task holds the whole log of one key.
SLICE_MS = 86_400_000
#: Values below are seconds.
SECONDS_BELOW = 100_000_000_000


@dataclass
class OpenSession:
    """The open session of one key and its inactivity timer."""

    gap: int
    start: int = 0
    end: int = 0
    count: int = 0

    def timer(self) -> int:
        return self.end + self.gap

    def event(self, start: int, end: int, count: int = 1) -> tuple[int, int, int] | None:
        """Takes the next event in order of start; returns the session that its timer closed, if any."""
        closed = None
        if self.count and start > self.timer():
            closed = self.expire()
        if not self.count:
            self.start, self.end = start, end
        self.end = max(self.end, end)
        self.count += count
        return closed

    def expire(self) -> tuple[int, int, int] | None:
        """The final session, when the timer runs out or the input ends."""
        if not self.count:
            return None
        done = (self.start, self.end, self.count)
        self.start = self.end = self.count = 0
        return done


def clean_commands(log: DataFrame) -> DataFrame:
    """(user_name, start, end): one row per session_id, the one with the latest created_at.

    Users are trimmed and lower-cased; null and blank ones are skipped, as are rows
    without session_id or started_at. Seconds become milliseconds; an end that is null or
    before its start equals the start. Of rows with equal created_at the later ingested,
    then the one with the greater end, counts.
    """
    latest = log.where("session_id IS NOT NULL").groupBy("session_id").agg(
        F.max(F.struct("created_at", "ingested_at", "ended_at", "started_at", "user")).alias("r")
    )

    def ms(c: str):
        return F.when(F.col(c) < SECONDS_BELOW, F.col(c) * 1000).otherwise(F.col(c))

    rows = latest.select(F.lower(F.trim("r.user")).alias("user_name"), ms("r.started_at").alias("start"), ms("r.ended_at").alias("e"))
    return rows.where("user_name <> '' AND start IS NOT NULL").select("user_name", "start", F.greatest("start", F.coalesce("e", "start")).alias("end"))


def _fold(keys: list[str], gap: int):
    """Runs the timers over a partition sorted by key and start; only one open session is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_, out = None, OpenSession(gap), []
        for x in frames:
            for row in zip(*(x[c] for c in keys), x["start"].tolist(), x["end"].tolist(), x["n"].tolist()):
                if row[:-3] != key:
                    if (done := open_.expire()) is not None:
                        out.append((*key, *done))
                    key = row[:-3]
                if (done := open_.event(*row[-3:])) is not None:
                    out.append((*key, *done))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=[*keys, "start", "end", "n"])
                out = []
        if (done := open_.expire()) is not None:
            out.append((*key, *done))
        if out:
            yield pd.DataFrame(out, columns=[*keys, "start", "end", "n"])

    return run


def sessionize(events: DataFrame, key: str = "user_name", start: str = "start", end: str = "end", gap: int = GAP_MS, slice_ms: int = SLICE_MS) -> DataFrame:
    """(key, session_start, session_end, duration_ms, events) of every key.

    A session ends when the next event starts more than `gap` after the latest end of all
    earlier events of the key. Stage one runs the timers within slices of time of each
    key, so a key with a third of all rows is spread over many tasks; stage two runs the
    same timers over the partial sessions, whose number per key is bounded by time, not
    by rows. Partial sessions merge exactly: their start and latest end carry all that a
    later event is compared with. Rows with a null key, start or end are skipped; equal
    and repeated events count each; an empty table has an empty result.
    """
    rows = events.select(F.col(key).alias("k"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.lit(1).cast("long").alias("n"))
    rows = rows.where("k IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").withColumn("slice", F.floor(F.col("start") / slice_ms).cast("long"))
    kind = rows.schema["k"].dataType.simpleString()
    parts = rows.repartition("k", "slice").sortWithinPartitions("k", "slice", "start")
    parts = parts.mapInPandas(_fold(["k", "slice"], gap), f"k {kind}, slice long, start long, end long, n long")
    whole = parts.repartition("k").sortWithinPartitions("k", "start").select("k", "start", "end", "n")
    whole = whole.mapInPandas(_fold(["k"], gap), f"k {kind}, start long, end long, n long")
    return whole.select(
        F.col("k").alias(key), F.col("start").alias("session_start"), F.col("end").alias("session_end"), (F.col("end") - F.col("start")).alias("duration_ms"), F.col("n").alias("events")
    )


def merged(parts: Iterable[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Events and partial sessions (start, end, count), in any order, as the fewest partial sessions: one pass of the timers."""
    open_, out = OpenSession(gap), []
    for start, end, n in sorted(parts):
        if (done := open_.event(start, end, n)) is not None:
            out.append(done)
    if (done := open_.expire()) is not None:
        out.append(done)
    return out


def sessionize_stream(events: DataFrame, key: str = "user_name", ts: str = "ts", end: str = "end", gap: int = GAP_MS, late: str = "1 day") -> DataFrame:
    """The streaming form: `ts` (timestamp) is the start, `end` (ms) the end of an event.

    Partial sessions merge in any order, so the state of a key is its open ones: at most
    one a gap within the time the watermark lags, however many events they have. Events
    of a key are merged inside each Arrow batch before they are shuffled, so a busy key sends
    few rows. The event-time timer of a key fires when the watermark passes an
    open session's latest end plus the gap; no event on time can reach it any more, and it
    is emitted with start, end, duration and count. An event later than `late` is dropped,
    or, if it was merged with one on time, may open a session of its own.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = events.schema[key].dataType.simpleString()

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for k, part in x.groupby("k", sort=False):
                at = part["start"].sort_values().to_numpy()
                for s, e, n in merged(zip(part["start"].tolist(), part["end"].tolist(), [1] * len(part)), gap):
                    # the latest start in it decides whether the partial session is late
                    last = int(at[at.searchsorted(max(s, e), "right") - 1])
                    rows.append((k, s, e, n, last))
            yield pd.DataFrame(rows, columns=["k", "start", "end", "n", "last"])

    def run(k, frames, state: GroupState):
        parts = list(zip(*state.get)) if state.exists else []
        for x in frames:
            parts = merged([*parts, *zip(x["start"].tolist(), x["end"].tolist(), x["n"].tolist())], gap)
        mark = state.getCurrentWatermarkMs()
        done = [p for p in parts if p[1] + gap < mark]
        waiting = parts[len(done) :]
        if waiting:
            state.update(tuple(list(c) for c in zip(*waiting)))
            state.setTimeoutTimestamp(max(min(p[1] for p in waiting) + gap, mark) + 1)
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame([(k[0], s, e, e - s, n) for s, e, n in done], columns=[key, "session_start", "session_end", "duration_ms", "events"])

    start = F.unix_millis(F.col(ts))
    rows = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("k"), start.alias("start"), F.greatest(start, F.coalesce(F.col(end), start)).alias("end"))
    # rows without a key move the watermark, then they are left out
    small = rows.where("k IS NOT NULL").mapInPandas(combine, f"k {kind}, start long, end long, n long, last long")
    bare = rows.where("k IS NULL").select("k", "start", "end", F.lit(0).cast("long").alias("n"), F.col("start").alias("last"))
    both = small.unionByName(bare).withColumn("last", F.timestamp_millis("last")).withWatermark("last", late)
    # the condition names the watermark's column, or it would be pushed below the watermark
    both = both.where(F.when(F.col("last").isNotNull(), F.col("k").isNotNull())).withColumnRenamed("k", key)
    return both.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, session_start long, session_end long, duration_ms long, events long", "starts array<long>, ends array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_sessions(events: DataFrame, batches: int = 3, gap: int = GAP_MS, late: str = "1 day", key: str = "user_name") -> DataFrame:
    """The sessions of a table of (key, start, end) as a stream finds them.

    The events arrive as files in `batches` deliveries by time, each taken up by a new run
    of the query over the same checkpoint, so the open sessions pass through stored state
    between them. A last delivery without a key lies beyond all timers and closes every session.
    """
    spark = events.sparkSession
    root = scratch(spark, "stream")
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key), F.timestamp_millis(F.col("start").cast("long")).alias("ts"), F.col("end").cast("long").alias("end")).where("ts IS NOT NULL")
    lo, hi = rows.agg(F.unix_millis(F.min("ts")), F.unix_millis(F.max(F.greatest("ts", F.timestamp_millis(F.coalesce("end", F.unix_millis("ts"))))))).first()
    if lo is None:
        return spark.createDataFrame([], f"{key} {kind}, session_start long, session_end long, duration_ms long, events long")
    step = (hi - lo) // batches + 1
    rows.limit(0).write.parquet(f"{root}/in")  # the source wants its folder
    source = spark.readStream.schema(f"{key} {kind}, ts timestamp, end long").parquet(f"{root}/in")
    found = sessionize_stream(source, key, gap=gap, late=late)
    part = F.floor((F.unix_millis("ts") - F.lit(lo)) / step)
    far = spark.range(1).select(F.lit(None).cast(kind).alias(key), (F.timestamp_millis(F.lit(hi + gap + 1000)) + F.expr(f"INTERVAL {late}") * 2).alias("ts"), F.lit(None).cast("long").alias("end"))
    for i in range(batches + 1):
        (rows.where(part == i) if i < batches else far).write.mode("append").parquet(f"{root}/in")
        q = found.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/out")


def top_users(sessions: DataFrame, key: str = "user_name") -> DataFrame:
    """Sessions, events and total duration of each user."""
    return sessions.groupBy(key).agg(
        F.count("*").alias("sessions"), F.sum("events").alias("events"), F.sum("duration_ms").alias("duration_ms"), F.max("session_end").alias("last_end")
    )


__all__ = ["GAP_MS", "OpenSession", "clean_commands", "sessionize", "sessionize_stream", "stream_sessions", "top_users"]
