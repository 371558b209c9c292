"""Queries of the live-state operators: their batch twins over events. Users are keys, event types payloads, a purchase is a finished frame."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import scratch
from ..streaming import live as T
from ..streaming import ordered as O
from .laps import r6
from .registry import query

EVENTS = {"frames": ("", "select user_id::varchar as key, ts, event_id as seq, event_type as payload, event_type = 'purchase' as finished from events"),
 "kept": ("frames", "select * from (select *, lag(payload) over (partition by key order by ts, seq) as p from frames) where p is null or p <> payload")}


def frames(v):
    return _framed(v.table("events"))


def _framed(e):
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"), (F.col("event_type") == "purchase").alias("finished"))


@query("t01_state_changes", "kept", "select key, seq, payload from kept", EVENTS)
def t01(v):
    return T.kept_states(frames(v)).select("key", "seq", "payload")


@query("t02_stable_finish", "frames", """select f.key, f.seq from frames f left join (select key, min((ts, seq)) as e from (select *, count(*) filter (where finished) over (partition by key, run order by ts, seq rows between unbounded preceding and current row) as streak from (
 select *, count(*) filter (where not finished) over (partition by key order by ts, seq rows between unbounded preceding and current row) as run from frames)) where streak >= 2 group by 1) x on x.key = f.key where e is null or (f.ts, f.seq) <= e""", EVENTS)
def t02(v):
    return T.stable_end(frames(v), 2).select("key", "seq")


@query("t03_dwell_time", "kept", "select key, seq, round((epoch_us(lead(ts) over (partition by key order by ts, seq)) - epoch_us(ts)) / 1e6, 3) as dwell_s from kept", EVENTS)
def t03(v):
    return T.dwell_time(T.kept_states(frames(v))).select("key", "seq", F.round("dwell_s", 3).alias("dwell_s"))


@query("t03_ordered_stream", "frames", """with ended as (select f.* from frames f left join (select key, min((ts, seq)) as e from (select *, count(*) filter (where finished) over (partition by key, run order by ts, seq rows between unbounded preceding and current row) as streak from (
 select *, count(*) filter (where not finished) over (partition by key order by ts, seq rows between unbounded preceding and current row) as run from frames)) where streak >= 2 group by 1) x on x.key = f.key where e is null or (f.ts, f.seq) <= e),
 k as (select * from (select *, lag(payload) over (partition by key order by ts, seq) as p from ended) where p is null or p <> payload)
 select key, seq, payload, round(dwell, 3) as dwell_s from (select *, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by key order by ts, seq)) / 1e6 as dwell from k) where epoch_us(ts) <= (select max(epoch_us(ts)) // 1000 * 1000 - 3600000000 from frames)""", EVENTS)
def t03_stream(v):
    """Events through the event-time stream: what it has released when its source is read, up to an hour before the last event."""
    source = v.spark.readStream.schema(v.table("events").schema).parquet(f"{v.root}/events.parquet*")
    out = scratch(v.spark, "stream")
    O.replay(_framed(source), f"{out}/kept", f"{out}/checkpoint", stable=2, late="1 hour")
    t = v.spark.read.schema("key string, ts timestamp, seq long, payload string, finished boolean, dwell_s double").parquet(f"{out}/kept")
    return t.select("key", "seq", "payload", F.round("dwell_s", 3).alias("dwell_s"))


@query("t04_capture_profile", "frames kept", """select key, polls, states, round(p50, 3) as p50, round(least, 3) as least, round(largest, 3) as largest, 24 - hours as never_seen from (select key, count(*) as polls, count(distinct hour(ts)) as hours from frames group by 1)
 join (select key, count(*) as states, median(d) as p50, min(d) as least, max(d) as largest from (select key, (epoch_us(lead(ts) over (partition by key order by ts, seq)) - epoch_us(ts)) / 1e6 as d from kept) group by 1) using (key)""", EVENTS)
def t04(v):
    f = frames(v)
    t = T.capture_profile(f, T.kept_states(f), F.hour("ts"), 0, 23)
    return t.select("key", "polls", "states", *[F.round(c, 3).alias(c) for c in ("p50", "least", "largest")], "never_seen")


@query("t05_lap_join_check", "laps", """select lead_lap, count(*) as n, round(avg(case when (driver_id + lap) % 6 <> 0 then 1.0::double else 0 end), 6) as agree from (select *, max(lap) over (partition by race_id, driver_id) = max(lap) over (partition by race_id) as lead_lap from laps) group by 1""")
def t05(v):
    lead = F.max("lap").over(W.partitionBy("race_id", "driver_id")) == F.max("lap").over(W.partitionBy("race_id"))
    off = F.when((F.col("driver_id") + F.col("lap")) % 6 == 0, F.col("running_pos") + 1).otherwise(F.col("running_pos"))
    s = v.laps.select("race_id", "driver_id", "lap", lead.alias("lead_lap"), off.alias("running_pos"))
    return r6(T.lap_join_check(s, v.laps), "agree")
