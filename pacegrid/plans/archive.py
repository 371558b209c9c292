"""Queries of sources, archive bookkeeping and conforming."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import archive as B
from ..operators import conform as C

from ..sources import tables as S
from .laps import r6, r7
from .registry import query

#: Events as a fetch ledger: a user is a contest, an event type a feed.
LEDGER = {"ledger": ("", "select event_id, user_id as race_id, event_type as feed, ts as fetched_at, md5(event_type || '|' || round(value * 100)::bigint % 4) as sha, case event_id % 10 when 0 then 'absent' when 1 then 'failed' else 'stored' end as outcome from events"),
 "latest": ("ledger", "select race_id, feed, outcome, sha, fetched_at from ledger qualify row_number() over (partition by race_id, feed order by fetched_at desc nulls last, sha desc) = 1"),
 "idx": ("ledger", "select distinct race_id, 1995 + race_id % 7 as year from ledger where race_id % 9 <> 0"),
 "grid": ("idx latest ledger", "select i.race_id, i.year, f.feed, case when outcome = 'stored' then 'stored' when outcome = 'absent' then 'absent' when outcome = 'failed' then 'failed' else 'pending' end as state from idx i cross join (select distinct feed from ledger) f left join latest l on l.race_id = i.race_id and l.feed = f.feed")}


def ledger(v):
    sha = F.md5(F.concat_ws("|", "event_type", (F.round(F.col("value") * 100).cast("long") % 4).cast("string")).cast("binary"))
    outcome = F.when(F.col("event_id") % 10 == 0, "absent").when(F.col("event_id") % 10 == 1, "failed").otherwise("stored")
    return v.table("events").select("event_id", F.col("user_id").alias("race_id"), F.col("event_type").alias("feed"), F.col("ts").alias("fetched_at"), sha.alias("sha"), outcome.alias("outcome"))


def latest(v):
    return B.latest_version(ledger(v).select("race_id", "feed", "fetched_at", "sha", "outcome"), ["race_id", "feed"], "fetched_at")


def index(v):
    return ledger(v).select("race_id").distinct().filter("race_id % 9 <> 0").withColumn("year", F.col("race_id") % 7 + 1995)


def grid(v):
    return B.coverage_grid(index(v), ledger(v).select("feed").distinct(), latest(v))


@query("b01_latest_version", "latest", "select race_id, feed, outcome, sha from latest", LEDGER)
def b01(v):
    return latest(v).select("race_id", "feed", "outcome", "sha")


@query("b02_coverage_grid", "grid", "select * from grid", LEDGER)
def b02(v):
    return grid(v).select("race_id", "year", "feed", "state")


@query("b03_coverage_rollup", "grid", "select feed, year, state, count(*) as n, count(distinct race_id) as races from grid group by grouping sets ((feed, state), (year, state), (state))", LEDGER)
def b03(v):
    return B.coverage_rollup(grid(v))


@query("b04_first_seen", "grid", "select feed, min(year) as first_year from grid where state = 'stored' group by 1", LEDGER)
def b04(v):
    return B.first_seen(grid(v))


@query("b05_failed_cells", "grid", "select race_id, year, feed, state from grid where state = 'failed' order by race_id, feed limit 20", LEDGER)
def b05(v):
    return B.failed_cells(grid(v), 20).select("race_id", "year", "feed", "state")


@query("b06_verify_hashes", "", """select coalesce(a.path, b.path) as path, case when b.path is null then 'missing' when a.path is null then 'unlisted' when bad then 'mismatched' else 'ok' end as state
 from (select 'f' || event_id as path from events where event_id % 7 <> 0) a full join (select 'f' || event_id as path, event_id % 5 = 0 as bad from events where event_id % 11 <> 0) b on a.path = b.path""")
def b06(v):
    e = v.table("events").select(F.concat(F.lit("f"), "event_id").alias("path"), F.concat_ws("|", "event_type", "props").alias("text"), "event_id")
    listed = e.filter("event_id % 7 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    files = e.filter("event_id % 11 <> 0").select("path", F.when(F.col("event_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return B.verify_hashes(listed, B.content_hashes(files))


@query("b07_detect_change", "ledger", """select n.event_id, case when n.outcome in ('failed', 'absent') then n.outcome when n.sha is not distinct from o.sha then 'unchanged' else 'stored' end as result from ledger n left join
 (select race_id, feed, sha from ledger where event_id % 2 = 0 qualify row_number() over (partition by race_id, feed order by fetched_at desc, sha desc) = 1) o on o.race_id = n.race_id and o.feed = n.feed where n.event_id % 2 = 1""", LEDGER)
def b07(v):
    t = ledger(v)
    old = B.latest_version(t.filter("event_id % 2 = 0").select("race_id", "feed", "fetched_at", "sha"), ["race_id", "feed"], "fetched_at")
    new = t.filter("event_id % 2 = 1").withColumnRenamed("outcome", "http")
    return B.detect_change(new, old, ["race_id", "feed"]).select("event_id", F.col("outcome").alias("result"))


@query("b08_majority_valid", "ledger", "select race_id, avg(case when outcome = 'stored' and sha < '8' then 1.0::double else 0 end) > 0.5 as valid from ledger group by 1", LEDGER)
def b08(v):
    return B.majority_valid(ledger(v), "race_id", (F.col("outcome") == "stored") & (F.col("sha") < "8"))


@query("b09_has_run", "", "select o_orderkey, coalesce(nullif(o_custkey % 3, 0) > 0, false) or coalesce(o_totalprice - 200000 > 0, false) or coalesce(trim(case when o_orderstatus = 'F' then ' ' else o_orderstatus end) <> '', false) as has_run from orders")
def b09(v):
    o = v.table("orders")
    return o.select("o_orderkey", B.has_run(F.nullif(F.col("o_custkey") % 3, F.lit(0)), F.col("o_totalprice") - 200000, F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.col("o_orderstatus"))).alias("has_run"))


@query("b10_parse_date", "", """select event_id, case event_id % 4 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) when 2 then date_trunc('day', ts) end as t from events""")
def b10(v):
    e = v.table("events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 4 == 0, iso).when(F.col("event_id") % 4 == 1, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 4 == 2, F.concat(F.substring(iso, 1, 10), F.lit(" evening"))).otherwise(F.lit("soon"))
    return e.select("event_id", B.parse_date_lenient(text).cast("timestamp_ntz").alias("t"))


@query("b11_refresh_candidates", "idx latest ledger", """select distinct i.race_id, f.feed from (select *, date '2024-01-01' + (race_id % 60)::int as d from idx) i cross join (select distinct feed from ledger) f left join latest l on l.race_id = i.race_id and l.feed = f.feed
 where (date '2024-02-15' - d between 0 and 21 or outcome is null or outcome = 'failed') and d <= date '2024-02-15'""", LEDGER)
def b11(v):
    i = index(v).withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("race_id") % 60).cast("int")))
    return B.refresh_candidates(i, ledger(v).select("feed").distinct(), latest(v), F.lit("2024-02-15").cast("date"))


PRINT = {"prints": ("latest", "select race_id, md5('v1|' || string_agg(feed || ':' || sha, '|' order by feed || ':' || sha)) as fingerprint from latest group by 1"), **LEDGER}


def prints(v):
    return B.build_fingerprint(latest(v), "race_id", "v1")


@query("b12_build_fingerprint", "prints", "select * from prints", PRINT)
def b12(v):
    return prints(v)


@query("b13_incremental_rebuild", "prints ledger", "select race_id, case when race_id % 5 = 0 or race_id % 6 = 0 then 'new' else 'old' end as built, count(*) as n from prints join ledger using (race_id) group by 1, 2", PRINT)
def b13(v):
    state, t = prints(v), ledger(v)
    before = state.filter("race_id % 5 <> 0").withColumn("fingerprint", F.when(F.col("race_id") % 6 == 0, F.lit("x")).otherwise(F.col("fingerprint")))
    rows = lambda keys, tag: t.join(keys, "race_id", "left_semi").groupBy("race_id").agg(F.count("*").alias("n")).withColumn("built", F.lit(tag))
    return B.incremental_rebuild(state, before, rows(before, "old"), lambda k: rows(k, "new"), "race_id").select("race_id", "built", "n")


@query("b14_patch_columns", "contests", "select race_id, case when race_id % 4 = 0 then 'patched' else venue end as venue, case when race_id % 4 = 0 and race_id % 8 <> 0 then 99 else month end as month from contests")
def b14(v):
    p = v.contests.filter("race_id % 4 = 0").select("race_id", F.lit("patched").alias("venue"), F.when(F.col("race_id") % 8 != 0, 99).alias("month"))
    return B.patch_columns(v.contests.select("race_id", "venue", "month"), p, "race_id", ["venue", "month"])


# Sources.


@query("s02_path_keys", "ledger", """select event_id, case when event_id % 3 = 2 then null else 1 end as series, 2024 as year, case when event_id % 3 = 2 then null else race_id end as race_id, case when event_id % 3 = 2 then 'index' else feed end as feed, case when event_id % 3 = 1 then null else '20240101T000000' end as version from ledger""", LEDGER)
def s02(v):
    t = ledger(v)
    path = F.when(F.col("event_id") % 3 == 0, F.format_string("file:/a/series_1/2024/%d/%s/20240101T000000.json.gz", "race_id", "feed")).when(
        F.col("event_id") % 3 == 1, F.format_string("file:/a/series_1/2024/%d/%s.json.gz", "race_id", "feed")
    ).otherwise(F.lit("file:/a/index/2024/20240101T000000.json.gz"))
    return t.select("event_id", path.alias("path")).select("event_id", *[c.alias(k) for k, c in S.path_keys(F.col("path")).items()])


@query("s04_race_index_latest", "contests", """select year, case when month <= 6 then 1 else 2 end as series, race_id, year as season from contests where month < 12""")
def s04(v):
    c = v.contests
    snap = lambda part, shift, bump, ts: part.groupBy("year").agg(*[F.collect_list(F.when(cond, F.struct("race_id", (F.col("year") + bump).alias("season")))).alias(n) for n, cond in (("series_1", F.col("month") <= 6), ("series_2", F.col("month") > 6))]).withColumn("fetched_at", F.lit(ts))
    # an older full snapshot, the newest good one, and a newer one that carries the wrong season
    shots = snap(c, 0, 0, "2024-01-01").unionByName(snap(c.filter("month < 12"), 0, 0, "2024-02-01")).unionByName(snap(c, 0, 1, "2024-03-01"))
    return S.race_index_latest(shots).select("year", "series", "race_id", "season")


@query("s05_fallback_union", "entries", "select race_id, driver_id, 'a' as src from entries where race_id % 3 <> 0 union all select race_id, driver_id, 'b' from entries where race_id % 3 = 0 and race_id % 2 = 0")
def s05(v):
    e = v.entries.select("race_id", "driver_id")
    return S.fallback_union(e.filter("race_id % 3 <> 0").withColumn("src", F.lit("a")), e.filter("race_id % 2 = 0").withColumn("src", F.lit("b")), ["race_id"])


@query("s06_trim_index", "", "select o_orderkey, nullif(trim(case when o_orderstatus = 'F' then '  ' else ' ' || o_orderpriority end), '') as title, o_orderstatus = 'O' as has_run from orders")
def s06(v):
    t = v.table("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("title"), "o_orderstatus")
    return S.trim_index(t, ["title"], ["o_orderkey"], F.col("o_orderstatus") == "O")


@query("s11_seed_dim", "contests", "select race_id, venue, case venue when 'v01' then 'short' when 'v05' then 'road' else 'UNIQ' end as kind from contests")
def s11(v):
    return S.seed_dim(v.contests.select("race_id", "venue"), "venue", {"v01": "short", "v05": "road"}, "kind").select("race_id", "venue", "kind")


SCORES = {"scores": ("runs", "select venue, family, round(avg(start), 6) as start_score, round(avg(finish), 6) as finish_score, round(avg(laps_completed), 6) as lap_score from runs group by 1, 2")}


def scores(v):
    return v.runs.groupBy("venue", "family").agg(*[F.round(F.avg(c), 6).alias(n) for c, n in (("start", "start_score"), ("finish", "finish_score"), ("laps_completed", "lap_score"))])


@query("s12_unpivot_scores", "scores", "unpivot scores on start_score, finish_score, lap_score into name name value score".replace("unpivot scores", "select venue, family, name, score from (unpivot scores") + ")", SCORES)
def s12(v):
    return S.unpivot_scores(scores(v), ["venue", "family"], ["start_score", "finish_score", "lap_score"])


@query("s13_widen_union", "entries", "select race_id, round(a.v, 6) as led, round(b.v, 6) as spread from (select race_id, sum(laps_completed)::double as v from entries where race_id % 3 <> 0 group by 1) a full join (select race_id, stddev_samp(finish - start) as v from entries where race_id % 5 <> 0 group by 1) b using (race_id)")
def s13(v):
    a = v.entries.filter("race_id % 3 <> 0").groupBy("race_id").agg(F.sum("laps_completed").alias("value"))
    b = v.entries.filter("race_id % 5 <> 0").groupBy("race_id").agg(F.stddev_samp(F.col("finish") - F.col("start")).alias("value"))
    return r6(S.widen_union({"led": a, "spread": b}, ["race_id"]), "led", "spread")


@query("s15_upsert_log", "contests", "select race_id, case when race_id % 4 = 0 then 'new' else 'old' end as src from contests where race_id % 3 <> 0 or race_id % 4 = 0")
def s15(v):
    c = v.contests.select("race_id")
    old, new = c.filter("race_id % 3 <> 0").withColumn("src", F.lit("old")), c.filter("race_id % 4 = 0").withColumn("src", F.lit("new"))
    return S.upsert_log(S.upsert_log(old, new, ["race_id"]), new, ["race_id"])


@query("s16_dim_with_provenance", "contests", "select venue, family, md5('source') as source_sha256, '1.0' as package_version, '2024-01-01' as built_at from contests group by 1, 2")
def s16(v):
    return S.dim_with_provenance(v.contests.select("venue", "family").distinct(), F.md5(F.lit("source").cast("binary")), "1.0", "2024-01-01")


# Nested documents, made from the flat views; extracting them must give the views back.


def weekend(v):
    e = v.entries.join(v.contests.select("race_id", "venue", "month"), "race_id")
    result = F.struct("driver_id", "finish", "start", "status", F.col("driver_id").cast("string").alias("car_number"), "laps_completed")
    docs = e.groupBy("race_id").agg(F.collect_list(result).alias("results"), F.first("venue").alias("venue"), F.first("month").alias("month"))
    cautions = v.lap_flags.filter("flag_state = 2").groupBy("race_id").agg(F.array_sort(F.collect_list(F.struct(F.col("lap").alias("start_lap"), (F.col("lap") + 1).alias("end_lap"), F.lit("debris").alias("reason")))).alias("caution_segments"))
    runs = v.laps.filter("lap <= 2").groupBy("race_id", "lap").agg(F.collect_list(F.struct("driver_id", F.col("lap_time").alias("best_lap_time"))).alias("results"))
    runs = runs.groupBy("race_id").agg(F.collect_list(F.struct((F.col("race_id") * 10 + F.col("lap")).alias("run_id"), F.col("lap").alias("run_type"), "results")).alias("weekend_runs"))
    t = docs.join(cautions, "race_id", "left").join(runs, "race_id", "left")
    stages = F.transform(F.array(F.lit(1), F.lit(2)), lambda s: F.struct(s.alias("stage"), F.transform(F.filter("results", lambda r: r["finish"] <= 3), lambda r: F.struct(r["driver_id"].alias("driver_id"), (r["finish"] * s).alias("place"))).alias("results")))
    leaders = F.transform("caution_segments", lambda c: F.struct(c["start_lap"], c["end_lap"], F.lit("7").alias("car_number")))
    events = F.array(F.struct(F.lit("Practice").alias("event_name"), F.lit("09:00").alias("start_time")), F.struct(F.lit("Race").alias("event_name"), F.concat(F.col("month").cast("string"), F.lit(":00")).alias("start_time")))
    doc = F.struct(F.col("venue").alias("race_name"), (F.col("month") * 100.0).alias("total_miles"), "results", "caution_segments", leaders.alias("race_leaders"), stages.alias("stage_results"), events.alias("schedule"))
    one = F.array(doc)
    # every seventh document is empty, every eleventh has no array at all
    return t.select("race_id", F.when(F.col("race_id") % 11 == 0, None).when(F.col("race_id") % 7 == 0, F.slice(one, 1, 0)).otherwise(one).alias("weekend_race"), "weekend_runs")


_IN = "race_id % 11 <> 0 and race_id % 7 <> 0"


@query("c01_extract_results", "entries", f"select race_id, driver_id, finish, start, status, driver_id::varchar as car_number, laps_completed from entries where {_IN}")
def c01(v):
    return C.extract_results(weekend(v))


@query("c02_extract_practice_runs", "laps", "select race_id, race_id * 10 + lap as run_id, lap as run_type, driver_id, round(lap_time, 7) as best_lap_time from laps where lap <= 2")
def c02(v):
    return r7(C.extract_practice_runs(weekend(v)), "best_lap_time")


_SEG = f"select race_id, row_number() over (partition by race_id order by lap) - 1 as seq, lap as start_lap, lap + 1 as end_lap, {{x}} from lap_flags where flag_state = 2 and {_IN}"


@query("c03_extract_caution_segments", "lap_flags", _SEG.format(x="'debris' as reason"))
def c03(v):
    return C.extract_segments(weekend(v), "caution_segments")


@query("c04_extract_stage_results", "entries", f"select race_id, s as stage, driver_id, finish * s as place from entries, range(1, 3) r(s) where finish <= 3 and {_IN}")
def c04(v):
    return C.extract_stage_results(weekend(v))


@query("c05_extract_leader_segments", "lap_flags", _SEG.format(x="'7' as car_number"))
def c05(v):
    return C.extract_segments(weekend(v), "race_leaders")


@query("c06_extract_race_meta", "contests", f"select race_id, case when {_IN} then venue end as race_name, case when {_IN} then month * 100.0::double end as total_miles from contests")
def c06(v):
    return C.extract_race_meta(weekend(v))


def lap_feed(v):
    d = v.laps.groupBy("race_id", "driver_id").agg(F.collect_list(F.struct(F.col("lap").alias("Lap"), F.col("lap_time").alias("LapTime"), F.col("running_pos").alias("RunningPos"))).alias("Laps"))
    d = d.groupBy("race_id").agg(F.collect_list(F.struct("driver_id", "Laps")).alias("laps"))
    f = v.lap_flags.groupBy("race_id").agg(F.collect_list(F.struct(F.col("flag_state").alias("FlagState"), F.col("lap").alias("LapsCompleted"))).alias("flags"))
    return d.join(f, "race_id")


@query("c07_extract_laps", "laps", "select race_id, driver_id, lap, round(lap_time, 7) as lap_time, running_pos from laps")
def c07(v):
    return r7(C.extract_laps(lap_feed(v)), "lap_time")


@query("c08_extract_lap_flags", "lap_flags", "select race_id, lap, flag_state from lap_flags")
def c08(v):
    return C.extract_lap_flags(lap_feed(v))


@query("c09_extract_flag_events", "lap_flags", "select race_id, row_number() over (partition by race_id order by lap) - 1 as seq, lap, flag_state from lap_flags")
def c09(v):
    feed = v.lap_flags.groupBy("race_id").agg(F.array_sort(F.collect_list(F.struct("lap", "flag_state"))).alias("events"))
    return C.extract_root_array(feed)


@query("c10_extract_pit_stops", "pit_stops", "select race_id, row_number() over (partition by race_id order by lap_count, driver_id) - 1 as seq, lap_count, driver_id, pit_in_rank, pit_out_rank, n_tires from pit_stops")
def c10(v):
    feed = v.pit_stops.groupBy("race_id").agg(F.array_sort(F.collect_list(F.struct("lap_count", "driver_id", "pit_in_rank", "pit_out_rank", "n_tires"))).alias("events"))
    return C.extract_root_array(feed)


@query("c11_extract_lap_notes", "lap_flags", "select race_id, lap, 'n' || k as note, k as n_ids from lap_flags, range(1, 3) r(k) where flag_state = 2")
def c11(v):
    notes = F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.struct(F.concat(F.lit("n"), k.cast("string")).alias("note"), F.sequence(F.lit(1), k).alias("driver_ids")))
    feed = v.lap_flags.filter("flag_state = 2").groupBy("race_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("lap").cast("string"), notes))).alias("laps"))
    return C.extract_lap_notes(feed).select("race_id", "lap", "note", F.size("driver_ids").cast("long").alias("n_ids"))


@query("c12_extract_live_final", "entries", "select race_id, driver_id::varchar as number, driver_id, 'd' || driver_id as full_name, start % 3 as n_led from entries")
def c12(v):
    led = F.transform(F.slice(F.array(F.lit(1), F.lit(2)), 1, F.col("start") % 3), lambda k: F.struct(k.alias("start_lap"), (k + 1).alias("end_lap")))
    car = F.struct(F.col("driver_id").cast("string").alias("number"), F.struct("driver_id", F.concat(F.lit("d"), F.col("driver_id").cast("string")).alias("full_name")).alias("driver"), led.alias("laps_led"))
    t = C.extract_live_final(v.entries.groupBy("race_id").agg(F.collect_list(car).alias("vehicles")))
    return t.select("race_id", "number", "driver_id", "full_name", F.size("laps_led").alias("n_led"))


@query("c13_dedupe_conflicts", "", """select l_orderkey, l_linenumber, count(distinct h) - 1 as conflicts, count(*) - count(distinct h) as copies, arg_min(q, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) as first_quantity from (
 select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity as q, l_returnflag || l_linestatus as h from lineitem) group by 1, 2""")
def c13(v):
    t = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return C.dedupe_count_conflicts(t, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "conflicts", "copies", F.col("l_quantity").alias("first_quantity"))


@query("c14_assign_seq", "", "select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq from events")
def c14(v):
    return C.assign_seq(v.table("events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "seq")


@query("c15_resolve_ids", "pit_stops entries", """with r as (select race_id, driver_id, (driver_id % 90)::varchar as num, case when driver_id % 4 = 0 then null else 'd' || driver_id % 97 end as nm from entries),
 a as (select race_id, num, min(driver_id) as d from r group by 1, 2 having count(distinct driver_id) = 1), b as (select race_id, nm, min(driver_id) as d from r where nm is not null group by 1, 2 having count(distinct driver_id) = 1)
 select p.race_id, p.lap_count, p.driver_id as true_id, coalesce(a.d, b.d) as driver_id, case when a.d is not null then 'number' when b.d is not null then 'name' else 'none' end as how from pit_stops p left join a on a.race_id = p.race_id and a.num = (p.driver_id % 90)::varchar left join b on b.race_id = p.race_id and b.nm = 'd' || p.driver_id % 97""")
def c15(v):
    number, name = (F.col("driver_id") % 90).cast("string"), F.concat(F.lit("d"), (F.col("driver_id") % 97).cast("string"))
    roster = v.entries.select("race_id", "driver_id", number.alias("number"), F.when(F.col("driver_id") % 4 != 0, name).alias("name"))
    events = v.pit_stops.select("race_id", "lap_count", F.col("driver_id").alias("true_id"), number.alias("number"), name.alias("name"))
    return C.resolve_ids(events, roster).select("race_id", "lap_count", "true_id", "driver_id", "how")


@query("c16_first_event_time", "contests", f"select race_id, month || ':00' as t from contests where {_IN}")
def c16(v):
    t = weekend(v).select("race_id", F.explode("weekend_race").alias("w"))
    return t.select("race_id", C.first_event_time(F.col("w.schedule"), "Race").alias("t"))


STATUS = {"status": ("contests entries laps", """select race_id, case when has_feed is null then 'not_attempted' when not has_feed then 'no feed' when n_results < 5 then 'few results' when n_finishers < 3 then 'few finishers' when n_laps < 30 then 'usable laps=' || n_laps else 'ok' end as reason from (
 select c.race_id, case when c.race_id % 13 = 0 then null else c.race_id % 7 <> 0 end as has_feed, e.n as n_results, e.f as n_finishers, l.n as n_laps from contests c join (select race_id, count(*) as n, count(*) filter (where status = 'running') as f from entries group by 1) e using (race_id) join (select race_id, count(*) as n from laps group by 1) l using (race_id))""")}


def status(v):
    e = v.entries.groupBy("race_id").agg(F.count("*").alias("n_results"), F.count_if(F.col("status") == "running").alias("n_finishers"))
    n = v.laps.groupBy("race_id").agg(F.count("*").alias("n_laps"))
    t = v.contests.select("race_id", F.when(F.col("race_id") % 13 != 0, F.col("race_id") % 7 != 0).alias("has_feed")).join(e, "race_id").join(n, "race_id")
    return C.parse_status(t, 5, 3, 30)


@query("c17_parse_status", "status", "select race_id, reason, reason = 'ok' as valid from status", STATUS)
def c17(v):
    return status(v).select("race_id", "reason", "valid")


@query("c18_build_races", "contests status", f"select c.race_id, c.year, coalesce(s.reason, 'not_attempted') as reason, coalesce(s.reason = 'ok', false) as valid, case when {_IN.replace('race_id', 'c.race_id')} then venue end as race_name from contests c left join (select * from status where race_id % 2 = 0) s using (race_id)", STATUS)
def c18(v):
    return C.build_races(v.contests.select("race_id", "year"), status(v).filter("race_id % 2 = 0"), C.extract_race_meta(weekend(v))).select("race_id", "year", "reason", "valid", "race_name")


@query("c19_normalise_entity", "entries", """with t as (select race_id, case when driver_id % 3 = 0 then ' ' || upper(team_name) || ' ' else lower(team_name) end as nm from entries), s as (select lower(trim(nm)) as key, nm, count(*) as n from t group by 1, 2)
 select key, nm as display, races from (select *, row_number() over (partition by key order by n desc, nm) as k from s) join (select lower(trim(nm)) as key, count(distinct race_id) as races from t group by 1) using (key) where k = 1""")
def c19(v):
    t = v.entries.select("race_id", F.when(F.col("driver_id") % 3 == 0, F.concat(F.lit(" "), F.upper("team_name"), F.lit(" "))).otherwise(F.lower("team_name")).alias("nm"))
    return C.normalise_entity(t, "nm")


@query("c20_parse_banking", "contests", "select race_id, greatest(month, month + 3)::double as max_banking, case when month % 2 = 0 then (month + 1.5)::double end as labelled_banking from contests")
def c20(v):
    text = F.concat(F.col("month").cast("string"), F.lit("-"), (F.col("month") + 3).cast("string"), F.lit(" degrees"), F.when(F.col("month") % 2 == 0, F.concat(F.lit("; "), (F.col("month") + 1.5).cast("string"), F.lit(" in the tri-oval"))).otherwise(F.lit("")))
    return v.contests.select("race_id", text.alias("text")).select("race_id", *[c.alias(k) for k, c in C.parse_banking(F.col("text")).items()])


#: Venue v02 has two rows in its second range, told apart by the month rule; v12 has none.
XWALK = {"xw": ("contests", "select venue as name, 1995 as first_year, 1997 as last_year, null as rule, venue || 'a' as track_id from contests where venue <> 'v12' group by 1 union all select venue, 1998, 9999, case when venue = 'v02' then 2 end, venue || 'b' from contests where venue <> 'v12' group by 1 union all select 'v02', 1998, 9999, 7, 'v02c'")}


@query("c21_range_join_xwalk", "contests xw", "select race_id, track_id from contests join xw on venue = name and year between first_year and last_year where rule is null or rule = month", XWALK)
def c21(v):
    names = v.contests.select("venue").distinct().filter("venue <> 'v12'")
    a = names.select(F.col("venue").alias("name"), F.lit(1995).alias("first_year"), F.lit(1997).alias("last_year"), F.lit(None).cast("array<int>").alias("months"), F.concat("venue", F.lit("a")).alias("track_id"))
    b = names.select(F.col("venue").alias("name"), F.lit(1998), F.lit(9999), F.when(F.col("venue") == "v02", F.array(F.lit(2))), F.concat("venue", F.lit("b")))
    c = names.filter("venue = 'v02'").select(F.col("venue").alias("name"), F.lit(1998), F.lit(9999), F.array(F.lit(7)), F.lit("v02c"))
    return C.range_join_xwalk(v.contests, a.union(b).union(c)).select("race_id", "track_id")


@query("c22_assign_era", "contests", "select race_id, era_key from contests")
def c22(v):
    eras = v.spark.createDataFrame([("e1", 0, 1997), ("e2", 1998, 1999), ("e3", 2000, 9999)], "era_key string, start_year int, end_year int")
    return C.assign_era(v.contests.drop("era_key"), eras).select("race_id", "era_key")


@query("c23_schedule_features", "contests", """select race_id, venue, year, row_number() over w as nth_at_venue, (select count(distinct p.year) from contests p where p.venue = t.venue and p.race_seq < t.race_seq) as prior_seasons,
 year - (select max(p.year) from contests p where p.venue = t.venue and p.race_seq < t.race_seq) as seasons_since, row_number() over (partition by venue, era_key order by race_seq) as nth_in_era, family in ('q1', 'q2') and year >= 1998 as power_rule from contests t window w as (partition by venue order by race_seq)""")
def c23(v):
    return C.schedule_features(v.contests, ["q1", "q2"], 1998)




# Round trips through files in the shared folder.


@query("s01_read_fetch_log", "", "select 'f' || event_id as path, event_type as feed, (user_id)::bigint as race_id, case event_id % 10 when 0 then 'absent' when 1 then 'failed' else 'stored' end as outcome from events")
def s01(v):
    path = S.scratch(v.spark, "fetch-log")
    t = ledger(v).select(F.concat(F.lit("f"), "event_id").alias("path"), "feed", "race_id", "outcome", F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"))
    t.write.json(path)
    empty = S.read_fetch_log(v.spark, path + "-missing")
    return S.read_fetch_log(v.spark, path).unionByName(empty).select("path", "feed", "race_id", "outcome")


@query("s03_read_nested", "entries", f"select race_id, driver_id, finish, start from entries where {_IN}")
def s03(v):
    path = S.scratch(v.spark, "weekend")
    weekend(v).write.json(path)
    schema = T._parse_datatype_string(C.WEEKEND)
    # one document a line here; multi-line files are read the same way
    t = v.spark.read.schema(schema).json(path)
    return C.extract_results(t).select("race_id", "driver_id", "finish", "start")


@query("s07_write_table", "entries", "select race_id, driver_id, case when race_id % 4 = 1 then finish + 1 else finish end as finish, race_id % 4 as bucket from entries")
def s07(v):
    path = S.scratch(v.spark, "table")
    schema = T._parse_datatype_string("race_id int, driver_id bigint, finish int, bucket int")
    t = v.entries.withColumn("bucket", F.col("race_id") % 4)
    S.write_table(t, path, schema, "bucket")
    S.write_table(t.filter("bucket = 1").withColumn("finish", F.col("finish") + 1), path, schema, "bucket")  # only that partition is replaced
    return v.spark.read.schema(schema).parquet(path)


@query("s08_register_layer", "contests", "select race_id, venue from contests")
def s08(v):
    path = S.scratch(v.spark, "layer")
    v.contests.write.parquet(path)
    made = S.register_layer(v.spark, "silver", {"contests": path, "nothing": path + "-missing"})
    if made != ["silver_contests"]:
        raise ValueError(made)
    return v.spark.sql("select race_id, venue from silver_contests")


@query("s09_read_csv_table", "entries", "select race_id, driver_id, finish, status, start % 2 = 0 as even from entries")
def s09(v):
    path = S.scratch(v.spark, "csv")
    t = v.entries.select("race_id", "driver_id", "finish", "status", F.when(F.col("start") % 4 == 0, "True").when(F.col("start") % 2 == 0, "true").otherwise("False").alias("even"))
    t.write.option("header", True).csv(path)
    return S.read_csv_table(v.spark, path, T._parse_datatype_string("race_id int, driver_id bigint, finish int, status string, even boolean"))


@query("s10_read_json_union", "entries", "select race_id, driver_id, case when race_id % 2 = 0 then finish end as finish, case when race_id % 2 = 1 then status end as status from entries")
def s10(v):
    a, b = S.scratch(v.spark, "json"), S.scratch(v.spark, "json")
    v.entries.filter("race_id % 2 = 0").select("race_id", "driver_id", "finish").write.json(a)
    v.entries.filter("race_id % 2 = 1").select("race_id", "driver_id", "status").write.json(b)
    schema = T._parse_datatype_string("race_id int, driver_id bigint, finish int, status string")
    return v.spark.read.schema(schema).json([a, b])


@query("s14_append_log", "contests", "select race_id, 'a' as src from contests union all select race_id, 'b' from contests where month = 1")
def s14(v):
    path = S.scratch(v.spark, "log")
    S.append_log(v.contests.select("race_id", F.lit("a").alias("src")), path)
    S.append_log(v.contests.filter("month = 1").select("race_id", F.lit("b").alias("src")), path)
    return v.spark.read.parquet(path)
