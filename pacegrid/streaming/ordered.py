"""Live states in event-time order (T01-T03): frames that come late, but within the watermark, are put in their place.

A key's frames wait in its state until the watermark has passed them; then they are taken in order of time (and `seq`), so what is kept, how
long a state lasted and where a key ended don't depend on which batch a frame came in. The rules are those of live.keep."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEPT = "key string, us long, seq long, payload string, finished boolean, dwell_s double"
STATE = "payload string, kept_us long, streak int, done boolean, wait_us array<long>, wait_seq array<long>, wait_payload array<string>, wait_finished array<boolean>"


def _read(events: DataFrame) -> DataFrame:
    t = events.select("key", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), "payload", F.coalesce("finished", F.lit(False)).alias("finished"))
    return t.filter("ts is not null and seq is not null")


def _told(kept: DataFrame) -> DataFrame:
    return kept.select("key", F.timestamp_micros("us").alias("ts"), "seq", "payload", "finished", "dwell_s")


def _frames(b: pd.DataFrame) -> list[tuple]:
    return [(int(t), int(s), p if isinstance(p, str) else None, bool(f)) for t, s, p, f in zip(b["us"], b["seq"], b["payload"], b["finished"])]


def released(frames: list[tuple], state: tuple, heartbeat_s: float | None, stable: int) -> tuple[list[tuple], tuple]:
    """What of the frames (us, seq, payload, finished), in order, is kept, each with the seconds since the kept one before it; and the new
    (payload, kept_us, streak, done)."""
    payload, kept, streak, done = state
    out = []
    for us, seq, p, finished in sorted(frames, key=lambda f: f[:2]):
        if done:
            break
        if kept is None or p != payload or (heartbeat_s is not None and us - kept >= heartbeat_s * 1e6):
            out.append((us, seq, p, finished, None if kept is None else (us - kept) / 1e6))
            payload, kept = p, us
        streak = streak + 1 if finished else 0
        done = streak >= stable
    return out, (payload, kept, streak, done)


def ordered_changes(events: DataFrame, heartbeat_s: float | None = None, stable: int = 3, late: str = "1 hour", forget_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """T01-T03, streaming, in event-time order. events: key, ts, seq, payload, finished. Columns of the result: those and dwell_s, the seconds since
    the kept state before it. A null ts, seq or payload: a frame without ts or seq is dropped, a null payload is a payload of its own.

    Frames wait until the watermark (the largest ts seen less `late`) has reached them, so a frame comes out that much later, and the last ones only
    when later frames of any key move the watermark on. Frames behind the watermark are dropped. A key without frames for forget_ms of event time after
    its last one is forgotten. State is a few numbers a key and the frames of the last `late`."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        payload, kept, streak, done, *waiting = state.get if state.exists else (None, None, 0, False, [], [], [], [])
        frames = list(zip(*waiting))
        for b in batches if not state.hasTimedOut else ():
            frames += _frames(b)
        mark = state.getCurrentWatermarkMs()
        ripe, rest = [f for f in frames if f[0] <= mark * 1000], [f for f in frames if f[0] > mark * 1000]
        out, now = released(ripe, (payload, kept, streak, done), heartbeat_s, stable)
        rest = [] if now[3] else rest  # the key has ended
        if state.hasTimedOut and not frames:
            state.remove()
        else:
            state.update((*now, *([f[i] for f in rest] for i in range(4))))
            first = min((f[0] for f in rest), default=None)
            last = max([mark, *(f[0] // 1000 for f in frames)])
            state.setTimeoutTimestamp(max(first // 1000, mark + 1) if first is not None else max(last, mark) + forget_ms)
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "us", "seq", "payload", "finished", "dwell_s"])

    watched = _read(events).withWatermark("ts", late)
    return _told(watched.groupBy("key").applyInPandasWithState(run, KEPT, STATE, "append", GroupStateTimeout.EventTimeTimeout))


def ordered_batch(events: DataFrame, heartbeat_s: float | None = None, stable: int = 3) -> DataFrame:
    """What the stream returns when all frames have come in time and been released, as one grouped batch: a key's frames by one task."""

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        out, _ = released(_frames(b), (None, None, 0, False), heartbeat_s, stable)
        return pd.DataFrame([(key[0], *x) for x in out], columns=["key", "us", "seq", "payload", "finished", "dwell_s"])

    return _told(_read(events).groupBy("key").applyInPandas(run, KEPT))


def replay(source: DataFrame, path: str, checkpoint: str, **how) -> None:
    """Runs the stream over what its source has now and appends what is released to Parquet at `path`; started again with the same
    checkpoint it goes on where it stopped, without loss or repetition."""
    changes = ordered_changes(source, **how)
    changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
