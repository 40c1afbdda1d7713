"""Streams of turn events: ingest, session state with a time to live, turn lifecycle, once-only notices, cadence, pairing.

Event time rules: state expires by event-time timers under a watermark, so that a stream that is read again gives the
same rows; every stream has a batch twin with the same result.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "turn string, seq long, ts timestamp, type string, call string, ok boolean, text string"
# The event types that are known, the sessions' time to live and the turns'.
EVENT_TYPES = ["text-delta", "reasoning-delta", "tool-step", "candidate-step", "steer-applied", "finish", "error", "start", "step", "plan", "sources", "usage"]
SESSION_TTL, TURN_TTL = "6 hours", "30 minutes"
#: Spark's setting that a stream runs a batch without rows when its watermark has moved.
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def parse_events(lines: DataFrame, known: list[str] | None = EVENT_TYPES) -> DataFrame:
    """Events of JSON lines (value). Lines that are no JSON object, or have no type, are dropped; unknown types get known = false."""
    e = lines.select(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e")).select("e.*").where("type is not null")
    return e.withColumn("known", F.col("type").isin(known) if known else F.lit(True))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The stream of the event files below a path."""
    return parse_events(spark.readStream.text(path))


def announce_once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (turn, text) once, although later steps repeat it. events: turn, text, ts; stream or table."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["turn", "text"]) if events.isStreaming else events.dropDuplicates(["turn", "text"])


def session_reads(events: DataFrame, ttl: str = SESSION_TTL) -> DataFrame:
    """Batch: adds `hit`: whether the session's last event lies within the time to live. events: turn, seq, ts."""
    order = Window.partitionBy("turn").orderBy("ts", "seq")
    last = F.lag("ts").over(order)
    return events.withColumn("hit", F.coalesce(F.col("ts") < last + F.expr(f"interval {ttl}"), F.lit(False)))


def session_state(events: DataFrame, ttl_seconds: int = 6 * 3600, delay: str = "0 seconds") -> DataFrame:
    """Stream: (turn, seq, hit) for each event; a session not seen for the time to live is a miss. A late update counts from its own time."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(parts)).sort_values(["ts", "seq"])
        last = state.get[0] if state.exists else None
        hits = []
        for ts in pdf["ts"]:
            now = ts.value // 1000
            hits.append(last is not None and now - last < ttl_seconds * 1_000_000)
            last = now if last is None else max(last, now)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"turn": key[0], "seq": pdf["seq"], "hit": hits})

    return events.withWatermark("ts", delay).groupBy("turn").applyInPandasWithState(step, "turn string, seq long, hit boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def turn_admissions(events: DataFrame, ttl: str = TURN_TTL) -> DataFrame:
    """Batch: (turn, seq, status) of events after a turn's first: `ok` within the time to live of its creation and before its end, else `not_found`. events: turn, seq, ts, type."""
    order = Window.partitionBy("turn").orderBy("ts", "seq")
    rows = events.withColumn("k", F.row_number().over(order)).withColumn("created", F.first("ts").over(order)).withColumn("ended", F.coalesce(F.sum(F.when(F.col("type") == "finish", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    alive = (F.col("ts") < F.col("created") + F.expr(f"interval {ttl}")) & (F.col("ended") == 0)
    return rows.where("k > 1").select("turn", "seq", F.when(alive, "ok").otherwise("not_found").alias("status"))


def open_turns(events: DataFrame, ttl_seconds: int = 1800, delay: str = "0 seconds", remember_seconds: int | None = None) -> DataFrame:
    """Stream twin of turn_admissions(): the timer runs from creation and doesn't slide.

    A turn past its time is remembered as ended for `remember_seconds` after its creation (ten times to live unless given),
    so that late events are not taken for a new turn; then its state goes.
    """
    remember = remember_seconds or 10 * ttl_seconds

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            created, ended = state.get
            if ended:
                state.remove()
            else:
                state.update((created, True))
                state.setTimeoutTimestamp(max(created // 1000 + remember * 1000, state.getCurrentWatermarkMs() + 1))
            return
        pdf = pd.concat(list(parts)).sort_values(["ts", "seq"])
        created, ended = state.get if state.exists else (None, False)
        out = []
        for seq, ts, kind in zip(pdf["seq"], pdf["ts"], pdf["type"], strict=True):
            now = ts.value // 1000
            if created is None:
                created = now
            else:
                out.append((key[0], seq, "ok" if now - created < ttl_seconds * 1_000_000 and not ended else "not_found"))
            ended = ended or kind == "finish"
        state.update((created, ended))
        state.setTimeoutTimestamp(max(created // 1000 + (remember if ended else ttl_seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["turn", "seq", "status"])

    return events.withWatermark("ts", delay).groupBy("turn").applyInPandasWithState(step, "turn string, seq long, status string", "created long, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)


def summary_due_stream(counts: DataFrame, every: int) -> DataFrame:
    """Stream: (conv_id, fired), as logs.summary_due(): `every` turns after the last summary. counts: conv_id, turn_count."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        out = []
        for n in sorted(x for pdf in parts for x in pdf["turn_count"]):
            if n - last >= every:
                last = int(n)
                out.append((key[0], last))
        state.update((last,))
        yield pd.DataFrame(out, columns=["conv_id", "fired"])

    return counts.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, fired long", "last long", "append", GroupStateTimeout.NoTimeout)


def tool_calls_stream(opened: DataFrame, closed: DataFrame, delay: str = "1 hour", within: str = "1 hour") -> DataFrame:
    """Stream: (turn, call, opened, closed, ok): each opening with its closing within an hour; unpaired ones once the watermark has passed. opened: turn, call, ts; closed: turn, call, ts, ok."""
    a = opened.withWatermark("ts", delay).select(F.col("turn").alias("turn"), F.col("call").alias("call"), F.col("ts").alias("opened"))
    b = closed.withWatermark("ts", delay).select(F.col("turn").alias("b_turn"), F.col("call").alias("b_call"), F.col("ts").alias("closed"), "ok")
    on = (F.col("turn") == F.col("b_turn")) & (F.col("call") == F.col("b_call")) & (F.col("closed") >= F.col("opened")) & (F.col("closed") <= F.col("opened") + F.expr(f"interval {within}"))
    return a.join(b, on, "leftOuter").select("turn", "call", "opened", "closed", "ok")


def turn_rollup(events: DataFrame) -> DataFrame:
    """(turn, calls, failures, last_at) of each turn so far: tool calls, and those that failed. events: turn, ts, type (call, result or error), ok; stream (update mode) or table."""
    failed = (F.col("type") == "error") | ((F.col("type") == "result") & ~F.coalesce("ok", F.lit(True)))
    return events.groupBy("turn").agg(F.count_if(F.col("type") == "call").alias("calls"), F.count_if(failed).alias("failures"), F.max("ts").alias("last_at"))


def run_updates(stream: DataFrame, folder: str, name: str, key: str) -> DataFrame:
    """Runs a stream in update mode over what there is now; the last row told of each key."""
    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/{name}/out")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/{name}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    told = stream.sparkSession.read.parquet(f"{folder}/{name}/out")
    return told.groupBy(key).agg(F.max_by(F.struct(*[c for c in stream.columns if c != key]), "batch").alias("r")).select(key, "r.*")


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, changed or removed files between two manifests (path, mtime)."""
    o, n = old.select("path", F.col("mtime").alias("was")), new.select("path", F.col("mtime").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") > F.col("was"), "changed")
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


_starting = threading.Lock()


def run_to_end(stream: DataFrame, folder: str, name: str, timers: bool = True) -> DataFrame:
    """Runs a stream over what there is now, into Parquet below a folder, and reads it.

    timers: whether those due at the end are run at once, in a batch without rows. For streams whose timers only free state
    they may wait for the next rows: that batch visits each key once more.
    """
    conf = stream.sparkSession.conf
    with _starting:  # the setting belongs to the session; a stream takes its own copy when it starts
        before = conf.get(EMPTY_BATCHES)
        conf.set(EMPTY_BATCHES, before if timers else "false")
        try:
            query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}/out").option("checkpointLocation", f"{folder}/{name}/state").outputMode("append").trigger(availableNow=True).start()
        finally:
            conf.set(EMPTY_BATCHES, before)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}/out")
