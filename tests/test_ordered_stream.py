"""The event-time stream over shuffled files, late frames and a restart, against its rules in order and its batch twin."""

import datetime as dt

from pyspark.sql import functions as F

from pacegrid.streaming import live, ordered

SCHEMA = "key string, ts timestamp, seq long, payload string, finished boolean"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows(n=60):
    """Frames of two keys, ten seconds apart; the first ends at its third finished frame in a row."""
    out = []
    for k in range(n):
        out.append(("a", T0 + dt.timedelta(seconds=10 * k), k, f"lap{k // 3}", 30 <= k < 33))
        out.append(("b", T0 + dt.timedelta(seconds=10 * k + 5), k, None if k % 7 == 0 else f"s{k % 4 // 2}", False))
    return out


def put(spark, tmp, name, part):
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp / name))


def test_shuffled_one_row_files_and_a_restart_equal_the_batch(spark, tmp_path):
    frames = rows(20)
    order = sorted(range(len(frames)), key=lambda i: (i // 8, i * 7919 % 8))  # out of order by up to 8 frames, 40 s
    source = str(tmp_path / "in")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        half = len(order) // 2
        for part in (order[:half], order[half:]):  # the second half comes after a stop
            for i in part:
                put(spark, tmp_path, "in", [frames[i]])
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).parquet(source)
            ordered.replay(stream, str(tmp_path / "out"), str(tmp_path / "ck"), stable=3, late="2 minutes")
        put(spark, tmp_path, "in", [("z", T0 + dt.timedelta(days=1), 0, "end", False)])  # moves the watermark past all others
        put(spark, tmp_path, "in", [("z", T0 + dt.timedelta(days=1, seconds=1), 1, "end", False)])
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        ordered.replay(stream, str(tmp_path / "out"), str(tmp_path / "ck"), stable=3, late="2 minutes")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = spark.read.parquet(str(tmp_path / "out")).filter("key <> 'z'")
    want = ordered.ordered_batch(spark.createDataFrame(frames, SCHEMA), stable=3)
    got, want = sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[2])), sorted(map(tuple, want.collect()), key=lambda r: (r[0], r[2]))
    assert got == want
    assert all(r[5] is None or r[5] >= 0 for r in got)


def test_a_late_frame_takes_its_place(spark, tmp_path):
    early, late = ("a", T0 + dt.timedelta(seconds=20), 2, "y", False), ("a", T0 + dt.timedelta(seconds=10), 1, "x", False)
    ends = [("z", T0 + dt.timedelta(hours=h), h, "end", False) for h in (2, 3)]
    for k, part in enumerate([[early], [late], ends[:1], ends[1:]]):
        put(spark, tmp_path, "in", part)
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        ordered.replay(stream, str(tmp_path / "out"), str(tmp_path / "ck"), late="1 minute")
    got = spark.read.parquet(str(tmp_path / "out")).filter("key = 'a'").orderBy("seq").collect()
    assert [(r["payload"], r["dwell_s"]) for r in got] == [("x", None), ("y", 10.0)]


def test_batch_form_equals_the_window_form(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    t = e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"), (F.col("event_type") == "purchase").alias("finished"))
    got = {(r["key"], r["seq"]) for r in ordered.ordered_batch(t, stable=10**6).collect()}
    assert got == {(r["key"], r["seq"]) for r in live.kept_states(t).collect()}
    ended = live.stable_end(t, 2)
    got = {(r["key"], r["seq"]) for r in ordered.ordered_batch(t, stable=2).collect()}
    assert got == {(r["key"], r["seq"]) for r in live.kept_states(ended).collect()}
