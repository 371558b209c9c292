"""The live-state stream against its rules and its batch twin."""

import pandas as pd
from pyspark.sql import functions as F

from pacegrid.streaming import live


def frames(rows):
    t0 = pd.Timestamp("2024-01-01")
    return pd.DataFrame([("k", t0 + pd.Timedelta(seconds=s), p, f) for s, p, f in rows], columns=["key", "ts", "payload", "finished"])


def test_changes_then_stable_finish():
    # five laps, then four finished frames: six kept, and the key ends at the third finished one
    rows = [(10 * k, f"lap{k}", False) for k in range(1, 6)] + [(60 + 10 * k, "flag", True) for k in range(4)]
    kept, state = live.keep(frames(rows), None, None, 3)
    assert len(kept) == 6 and state[3]
    later, _ = live.keep(frames([(200, "new", False)]), state, None, 3)
    assert later == []


def test_equal_frames_and_heartbeat():
    rows = [(10 * k, "same", False) for k in range(12)]
    assert len(live.keep(frames(rows), None, None, 3)[0]) == 1
    assert [x[3] for x in live.keep(frames(rows), None, 50, 3)[0]] == [None, 50.0, 50.0]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    t = e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"), (F.col("event_type") == "purchase").alias("finished"))
    t.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = live.state_changes(s, None, stable=10**6).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["key"], r["ts"], r["payload"]) for r in spark.table("kept").collect()}
    want = {(r["key"], r["ts"], r["payload"]) for r in live.kept_states(t).collect()}
    assert got == want
