"""Live states as a stream (rows T01-T05): kept state changes, stable finishes, dwell times. Each has a batch twin for replays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEPT = "key string, ts timestamp, payload string, finished boolean, dwell_s double"
STATE = "payload string, kept_us long, streak int, done boolean"


def keep(frames: pd.DataFrame, state: tuple | None, heartbeat_s: float | None, stable: int) -> tuple[list[tuple], tuple]:
    """The frames of one key that are kept, in time order, each with the time since the kept one before it; and the new state
    (last kept payload, its time in microseconds, run of finished frames, whether the key has ended)."""
    payload, kept, streak, done = state or (None, None, 0, False)
    out = []
    for ts, p, finished in sorted(zip(frames["ts"], frames["payload"], frames["finished"]), key=lambda f: f[0]):
        if done:
            break
        us = ts.value // 1000
        if kept is None or p != payload or (heartbeat_s is not None and us - kept >= heartbeat_s * 1e6):
            out.append((ts, p, bool(finished), None if kept is None else (us - kept) / 1e6))
            payload, kept = p, us
        streak = streak + 1 if finished else 0
        done = streak >= stable
    return out, (payload, kept, streak, done)


def state_changes(events: DataFrame, heartbeat_s: float | None = None, stable: int = 3, late: str = "1 hour", cap_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """T01-T03, streaming. events: key, ts, payload, finished. A frame is kept if its payload differs from the last kept one of its key, or the
    heartbeat has passed since that; after `stable` finished frames in a row the key has ended, and later frames are ignored.

    Events later than the watermark are dropped, and a key without events for cap_ms of event time is forgotten, so state is bounded by the keys
    that are live."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames = pd.concat(list(batches))
        out, new = keep(frames, state.get if state.exists else None, heartbeat_s, stable)
        state.update(new)
        last = int(frames["ts"].max().value // 1_000_000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + cap_ms)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "ts", "payload", "finished", "dwell_s"])

    watched = events.select("key", "ts", "payload", "finished").withWatermark("ts", late)
    return watched.groupBy("key").applyInPandasWithState(run, KEPT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stable_end(events: DataFrame, stable: int = 3) -> DataFrame:
    """T02, batch. The frames up to the first run of `stable` finished ones, that run's last frame included."""
    w = W.partitionBy("key").orderBy("ts", "seq")
    runs = F.sum(F.when(F.col("finished"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    t = events.withColumn("_run", runs).withColumn("_streak", F.sum(F.when(F.col("finished"), 1).otherwise(0)).over(W.partitionBy("key", "_run").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)))
    ended = F.coalesce(F.max(F.when(F.col("_streak") >= stable, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("_ended", ended).filter("_ended = 0").drop("_run", "_streak", "_ended")


def kept_states(events: DataFrame) -> DataFrame:
    """T01, batch, without a heartbeat: frames that differ from the one before."""
    w = W.partitionBy("key").orderBy("ts", "seq")
    return events.withColumn("_p", F.lag("payload").over(w)).withColumn("_k", F.row_number().over(w)).filter("_k = 1 or not payload <=> _p").drop("_p", "_k")


def dwell_time(kept: DataFrame) -> DataFrame:
    """T03. Seconds from a kept state to the next one."""
    nxt = F.lead("ts").over(W.partitionBy("key").orderBy("ts", "seq"))
    return kept.withColumn("dwell_s", (F.unix_micros(nxt) - F.unix_micros("ts")) / 1e6)


def capture_profile(events: DataFrame, kept: DataFrame, sequence: Column, first: int, last: int) -> DataFrame:
    """T04. Per key: polls, distinct states, refresh interval p50, least and largest, and how many values of a sequence were never seen."""
    polls = events.groupBy("key").agg(F.count("*").alias("polls"), F.collect_set(sequence).alias("_seen"))  # at most last - first + 1 values
    d = dwell_time(kept).groupBy("key").agg(F.count("*").alias("states"), F.percentile("dwell_s", F.lit(0.5)).alias("p50"), F.min("dwell_s").alias("least"), F.max("dwell_s").alias("largest"))
    never = F.size(F.array_except(F.sequence(F.lit(first), F.lit(last)), "_seen"))
    return polls.join(d, "key").select("key", "polls", "states", "p50", "least", "largest", never.alias("never_seen"))


def lap_join_check(streamed: DataFrame, archived: DataFrame) -> DataFrame:
    """T05. Share of streamed positions that equal the archived one of the same lap, by whether the entrant is on the lead lap. Works stream-static too."""
    a = archived.select("race_id", "driver_id", "lap", F.col("running_pos").alias("_p"))
    t = streamed.join(a, ["race_id", "driver_id", "lap"])
    return t.groupBy("lead_lap").agg(F.count("*").alias("n"), F.avg(F.when(F.col("running_pos") == F.col("_p"), 1.0).otherwise(0.0)).alias("agree"))
