"""Queries of the lap operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.segments import largest
from ..functions.stats import pearson
from ..operators import history as H
from ..operators import laps as L
from .registry import query


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def r7(df, *cols):
    """Lap times are cents over at most 50: no half falls on the seventh place."""
    return df.withColumns({c: F.round(c, 7) for c in cols})


def green(v):
    return L.green_laps(v.laps, v.lap_flags)


MED = {"med": ("green", "select race_id, lap, median(lap_time) as med from green group by 1, 2 having count(*) >= 5"),
       "rat": ("green med", "select g.*, lap_time / med as ratio from green g join med using (race_id, lap)")}


@query("l01_green_laps", "green", "select race_id, driver_id, lap, round(lap_time, 7) as lap_time, running_pos from green where lap_time > 0")
def l01(v):
    return r7(green(v).select("race_id", "driver_id", "lap", "lap_time", "running_pos"), "lap_time")


@query("l02_field_median", "med", "select race_id, lap, round(med, 8) as med from med", MED)
def l02(v):
    return L.field_median(green(v), 5).withColumn("med", F.round("med", 8))


PACE = {"pace": ("rat", """select race_id, driver_id, median(ratio) filter (where nth <= greatest(3, trunc(n * 0.85::double))) as pace_med85,
 avg(ratio) filter (where nth <= greatest(3, trunc(n * 0.7::double))) as pace_mean70, max(ratio) filter (where nth = greatest(1, trunc(n * 0.2::double))) as pace_p20,
 median(ratio) filter (where nth <= greatest(3, trunc(n * 0.2::double))) as pace_best, count(*) as nlaps
 from (select *, row_number() over (partition by race_id, driver_id order by ratio) as nth, count(*) over (partition by race_id, driver_id) as n from rat) where n >= 3 group by 1, 2"""), **MED}  # fmt: skip


@query("l03_pace_variants", "pace", "select race_id, driver_id, round(pace_med85, 6) as pace_med85, round(pace_mean70, 6) as pace_mean70, round(pace_p20, 6) as pace_p20, round(pace_best, 6) as pace_best, nlaps from pace", PACE)
def l03(v):
    return r6(L.pace_variants(green(v), 5, 3), "pace_med85", "pace_mean70", "pace_p20", "pace_best")


RUNS = {"seg": ("green", """select *, count(*) over (partition by race_id, driver_id, run) as run_len, lead(running_pos) over (partition by race_id, driver_id, run order by lap) as next_pos from (
 select *, lap - row_number() over (partition by race_id, driver_id order by lap) as run from green)""")}  # fmt: skip


@query("l04_segment_runs", "rat", """select race_id, driver_id, lap, run, count(*) over (partition by race_id, driver_id, run) as run_len from (
 select *, sum(brk) over (partition by race_id, driver_id order by lap) ::bigint as run from (select *, case when lag(lap) over w is null or lap <> lag(lap) over w + 1 or ratio > 1.2 then 1 else 0 end as brk
 from rat window w as (partition by race_id, driver_id order by lap)))""", MED)
def l04(v):
    return L.segment_runs(L.ratios(green(v), 5), F.col("ratio") > 1.20).select("race_id", "driver_id", "lap", "run", "run_len")


EFFECT = {"fe": ("rat", """select race_id, driver_id, ln(ratio) as y, age / 45.0::double as x0, age * age / 2025.0::double as x1, case when running_pos = 1 then 1.0::double else 0 end as x2,
 case when running_pos between 2 and 5 then 1.0::double else 0 end as x3, case when running_pos between 6 and 12 then 1.0::double else 0 end as x4, case when running_pos between 13 and 25 then 1.0::double else 0 end as x5
 from (select *, least(row_number() over (partition by race_id, driver_id, run order by lap) - 1, 45) as age, row_number() over (partition by race_id, driver_id, run order by lap) - 1 as j,
  count(*) over (partition by race_id, driver_id, run) as len from (
  select *, sum(brk) over (partition by race_id, driver_id order by lap) as run from (select *, case when lag(lap) over w is null or lap <> lag(lap) over w + 1 or ratio > 1.2 then 1 else 0 end as brk
   from rat window w as (partition by race_id, driver_id order by lap)))) where len >= 3 and j >= 1 and ratio <= 1.25"""), **MED}  # fmt: skip
_DEV = ", ".join(f"{c} - avg({c}) over (partition by race_id, driver_id) as {c}" for c in ["y", *L.X])


@query("l05_effect_cross_products", "fe", f"""select race_id, count(*) as n_rows, round(sum(x0 * x0), 6) as x0x0, round(sum(x0 * x1), 6) as x0x1, round(sum(x2 * x3), 6) as x2x3, round(sum(x5 * x5), 6) as x5x5, round(sum(x0 * y), 6) as x0y, round(sum(x5 * y), 6) as x5y
 from (select race_id, {_DEV} from fe) group by 1""", EFFECT)
def l05a(v):
    rows = L.effect_rows(green(v), 5, 3, skip=1)
    return r6(L.cross_products(rows).select("race_id", "n_rows", "x0x0", "x0x1", "x2x3", "x5x5", "x0y", "x5y"), "x0x0", "x0x1", "x2x3", "x5x5", "x0y", "x5y")


@query("l05_fixed_effect_pace")
def l05(v):
    return r6(L.fixed_effect_pace(L.effect_rows(green(v), 5, 3, skip=1), 10, 3, 1), "fepace")


PRACTICE = {"practice": ("laps", "select race_id, driver_id, case when lap % 7 = 0 then 0 else lap_time end as best_lap_time from laps where lap <= 8")}


def practice(v):
    return v.laps.filter("lap <= 8").select("race_id", "driver_id", F.when(F.col("lap") % 7 == 0, 0.0).otherwise(F.col("lap_time")).alias("best_lap_time"))


@query("l06_best_practice", "practice", "select race_id, driver_id, round(min(best_lap_time), 7) as practice from practice where best_lap_time > 0 group by 1, 2", PRACTICE)
def l06(v):
    return r7(L.best_practice(practice(v)), "practice")


@query("l07_entrant_race", "entries pace practice", """select e.race_id, e.driver_id, finish, start, status, laps_completed, round(pace_med85, 6) as pace_med85, nlaps, round(p.practice, 7) as practice
 from entries e left join pace using (race_id, driver_id) left join (select race_id, driver_id, min(best_lap_time) as practice from practice where best_lap_time > 0 group by 1, 2) p using (race_id, driver_id)""", PACE | PRACTICE)
def l07(v):
    g = green(v)
    t = L.build_entrant_race(v.entries, L.pace_variants(g, 5, 3), L.fixed_effect_pace(L.effect_rows(g, 5, 3, skip=1), 10, 3, 1), L.best_practice(practice(v)))
    return r7(r6(t.select("race_id", "driver_id", "finish", "start", "status", "laps_completed", "pace_med85", "nlaps", "practice"), "pace_med85"), "practice")


PASS = {"pas": ("seg", """select race_id, driver_id, count(*) filter (where next_pos < running_pos) as passes_made, count(*) filter (where next_pos > running_pos) as times_passed,
 count(*) filter (where next_pos < running_pos and next_pos <= 15) as quality_passes from seg group by 1, 2"""), **RUNS}


@query("l08_passes", "pas", "select * from pas", PASS)
def l08(v):
    return L.passes(green(v))


DURABLE = {"dur": ("seg", """select race_id, driver_id, count(*) filter (where worst < running_pos) as durable from (
 select *, max(running_pos) over (partition by race_id, driver_id, run order by lap rows between 1 following and 6 following) as worst from seg) group by 1, 2"""), **RUNS}


@query("l09_durable_passes", "dur", "select * from dur", DURABLE)
def l09(v):
    return L.durable_passes(green(v))


@query("l10_fastest_laps", "green", """select race_id, driver_id, coalesce(t.n, 0) as tied, coalesce(o.n, 0) as one from
 (select race_id, driver_id, count(*) as n from (select *, rank() over (partition by race_id, lap order by lap_time) as k from green) where k = 1 group by 1, 2) t full join
 (select race_id, driver_id, count(*) as n from (select *, row_number() over (partition by race_id, lap order by lap_time, driver_id) as k from green) where k = 1 group by 1, 2) o using (race_id, driver_id)""")
def l10(v):
    g, zero = green(v), F.lit(0).cast("long")
    t = L.fastest_laps(g).withColumnRenamed("fastest_laps", "tied").join(L.fastest_laps(g, False).withColumnRenamed("fastest_laps", "one"), L.RUN, "full")
    return t.select("race_id", "driver_id", F.coalesce("tied", zero).alias("tied"), F.coalesce("one", zero).alias("one"))


CLOSE = {"clo": ("green", """select g.race_id, g.driver_id, case when max(lap) >= max(l_start) then (arg_min(running_pos, case when lap >= l_start then lap end) - arg_max(running_pos, lap))::double end as closers
 from green g join (select race_id, g[floor(0.9::double * len(g))::int + 1] as l_start from (select race_id, list_sort(list(distinct lap)) as g from green group by 1)) s using (race_id) group by 1, 2""")}
LOOP = {"loops": ("green lap_flags pas clo", """select b.race_id, b.driver_id, n_green_race, green_flag_laps, arp, passes_made, times_passed, passes_made - times_passed as pass_diff, quality_passes,
 quality_passes / n_green_race::double as quality_pass_rate, coalesce(f.n, 0) as fastest_laps, coalesce(f.n, 0) / n_green_race::double as fastest_lap_share, laps_top15, laps_top15 / n_green_race::double as laps_top15_rate, closers
 from (select race_id, driver_id, count(*) as green_flag_laps, avg(running_pos) as arp, count(*) filter (where running_pos <= 15) as laps_top15 from green group by 1, 2) b
 join pas using (race_id, driver_id) left join clo using (race_id, driver_id)
 left join (select race_id, driver_id, count(*) as n from (select *, rank() over (partition by race_id, lap order by lap_time) as k from green) where k = 1 group by 1, 2) f using (race_id, driver_id)
 join (select race_id, count(distinct lap) as n_green_race from lap_flags where flag_state = 1 group by 1) using (race_id)"""), **CLOSE, **PASS}  # fmt: skip


def loops(v):
    return L.loop_metrics(green(v), v.lap_flags)


@query("l11_loop_metrics", "loops", """select race_id, driver_id, n_green_race, green_flag_laps, round(arp, 6) as arp, passes_made, times_passed, pass_diff, quality_passes, round(quality_pass_rate, 6) as quality_pass_rate,
 fastest_laps, round(fastest_lap_share, 6) as fastest_lap_share, laps_top15, round(laps_top15_rate, 6) as laps_top15_rate, closers from loops""", LOOP)
def l11(v):
    return r6(loops(v), "arp", "quality_pass_rate", "fastest_lap_share", "laps_top15_rate")


@query("l12_closers", "clo", "select race_id, driver_id, closers from clo", CLOSE)
def closers_of(v):
    return L.closers(green(v))


#: The six measures of W08 and W09, with the sign of "better".
SIX = {"arp": -1, "pass_diff": 1, "quality_pass_rate": 1, "fastest_lap_share": 1, "laps_top15_rate": 1, "closers": 1}


def _six_hist(c):
    return f"""select race_id, driver_id, sum(v * pow(2, -(nth - 1) / 8.0::double)) / sum(pow(2, -(nth - 1) / 8.0::double)) as {c}_h, count(*) as {c}_n from (select t.race_id, t.driver_id, h.{c} as v,
 row_number() over (partition by t.race_id, t.driver_id order by h.race_id desc) as nth from loops t join loops h on h.driver_id = t.driver_id and h.race_id < t.race_id where h.{c} is not null) x group by 1, 2"""


HIST = {"lh": ("loops " + " ".join(f"q_{c}" for c in SIX), "select t.race_id, t.driver_id, coalesce(closers_n, 0) as closers_n, " + ", ".join(f"{c}_h" for c in SIX) + " from loops t " + " ".join(f"left join q_{c} using (race_id, driver_id)" for c in SIX)), **{f"q_{c}": ("loops", _six_hist(c)) for c in SIX}, **LOOP}


def histories(v):
    t = loops(v)
    for c in SIX:
        t = H.hl_mean_prior(t, F.col(c), f"{c}_h", ["driver_id"], ["race_id"], count="closers_n" if c == "closers" else None)
    return t.select("race_id", "driver_id", "closers_n", *[f"{c}_h" for c in SIX])


@query("w08_loop_histories", "lh", "select race_id, driver_id, closers_n, " + ", ".join(f"round({c}_h, 6) as {c}_h" for c in SIX) + " from lh", HIST)
def w08(v):
    return r6(histories(v), *[f"{c}_h" for c in SIX])


_OKS = " and ".join(f"{c}_h is not null and stddev_samp({c}_h) over w > 0 and count({c}_h) over w >= 2" for c in SIX)
_SUM = " + ".join(f"{s} * ({c}_h - avg({c}_h) over w) / nullif(stddev_samp({c}_h) over w, 0)" for c, s in SIX.items())


@query("w09_composite_z", "lh", f"select race_id, driver_id, round(case when {_OKS} then ({_SUM}) / 6 end, 6) as composite from lh window w as (partition by race_id)", HIST)
def w09(v):
    return r6(H.composite_z(histories(v), {f"{c}_h": s for c, s in SIX.items()}, ["race_id"], "composite").select("race_id", "driver_id", "composite"), "composite")


RESTART = {"rst": ("lap_flags", "select race_id, lap from (select *, lag(flag_state) over w as f0, lag(lap) over w as l0 from lap_flags window w as (partition by race_id order by lap)) where f0 = 2 and flag_state = 1 and lap = l0 + 1"),
 "moves": ("rst seg pit_stops", """select a.race_id, a.driver_id, a.lap, abs(b.running_pos - a.running_pos) as delta from seg a join rst using (race_id, lap)
 join seg b on b.race_id = a.race_id and b.driver_id = a.driver_id and b.run = a.run and b.lap = a.lap + 2
 where not exists (select 1 from pit_stops p where p.race_id = a.race_id and p.driver_id = a.driver_id and abs(a.lap - p.lap_count) <= 1)"""), **RUNS}  # fmt: skip


def moves(v):
    return L.restart_moves(green(v), v.lap_flags, v.pit_stops, 2, 1)


@query("l13_restarts", "rst", "select * from rst", RESTART)
def l13(v):
    return L.restarts(v.lap_flags)


@query("l14_restart_volatility", "moves", "select race_id, round(avg(delta), 6) as v, count(*) as e from moves group by 1", RESTART)
def l14(v):
    return r6(L.restart_volatility(moves(v)), "v")


@query("l15_restart_retention", "moves entries", """select race_id, round(avg(case when delta <= 1 then 1.0::double else 0 end), 6) as v, count(*) as e from moves join (
 select race_id, driver_id from (select *, count(start) over (partition by race_id) as field from entries) where start <= field / 2::double) using (race_id, driver_id) group by 1""", RESTART)
def l15(v):
    m = moves(v)
    return r6(L.restart_retention(m, v.entries), "v")


SLOPES = {"cleanruns": ("green pit_stops", "select *, lap - row_number() over (partition by race_id, driver_id order by lap) as run from green g where not exists (select 1 from pit_stops p where p.race_id = g.race_id and p.driver_id = g.driver_id and p.lap_count = g.lap)"),
 "slopes": ("cleanruns", """select a.race_id, a.driver_id, a.run, median((b.lap_time - a.lap_time) / (b.lap - a.lap)) as slope from (select *, count(*) over (partition by race_id, driver_id, run) as n from cleanruns) a
 join cleanruns b on b.race_id = a.race_id and b.driver_id = a.driver_id and b.run = a.run and b.lap > a.lap where n >= 3 group by 1, 2, 3""")}  # fmt: skip


def slopes(v):
    return L.run_slopes(green(v), v.pit_stops, 3)


@query("l16_theil_sen", "slopes", """select race_id, round(v, 6) as v, e, round(iqr, 6) as iqr from (select race_id, median(slope) as v, count(*) as e from slopes group by 1) join
 (select race_id, case when count(*) >= 2 then quantile_cont(m, 0.75) - quantile_cont(m, 0.25) end as iqr from (select race_id, driver_id, median(slope) as m from slopes group by 1, 2) group by 1) using (race_id)""", SLOPES)
def l16(v):
    return r6(L.theil_sen(slopes(v)), "v", "iqr")


AUTO = {"auto": ("green", """select race_id, driver_id, case when sa > 0 and sb > 0 then r end as r from (select race_id, driver_id, count(*) as n, stddev_pop(running_pos) filter (where nxt is not null) as sa, stddev_pop(nxt) as sb,
 corr(running_pos, nxt) as r from (select *, lead(running_pos) over (partition by race_id, driver_id order by lap) as nxt from green) group by 1, 2) where n >= 5""")}


@query("l17_lag1_autocorr", "auto", "select race_id, driver_id, round(r, 6) as r from auto", AUTO)
def l17(v):
    return r6(L.lag1_autocorr(green(v)), "r")


@query("l18_adjacency_index", "green entries contests", """select race_id, round(avg((same / (n - 1)::double) / (cc / (n * (n - 1))::double)), 6) as v, count(*) as e from (
 select race_id, lap, sum(same) as same, sum(c) as n, sum(c * (c - 1)) as cc from (select race_id, lap, make, count(*) as c, count(*) filter (where nxt = make) as same from (
 select g.race_id, g.lap, e.make, lead(e.make) over (partition by g.race_id, g.lap order by g.running_pos) as nxt from green g join contests c using (race_id) join entries e using (race_id, driver_id) where c.ttype = 'SS') group by 1, 2, 3)
 group by 1, 2) where n >= 2 and cc > 0 group by 1""")
def l18(v):
    return r6(L.adjacency_index(green(v), v.entries.select("race_id", "driver_id", "make"), v.contests.filter("ttype = 'SS'").select("race_id")), "v")


CAR = {"car": ("laps lap_flags", "select race_id, g * n as car_laps from (select race_id, count(*) as g from lap_flags where flag_state = 1 group by 1) join (select race_id, count(distinct driver_id) as n from laps group by 1) using (race_id)")}


@query("l19_green_car_laps", "car", "select * from car", CAR)
def l19(v):
    return L.green_car_laps(v.laps, v.lap_flags)


@query("l20_pass_difficulty", "car dur pas", """select race_id, round(-d / car_laps::double, 6) as v2, round(-p / car_laps::double, 6) as v1 from (select race_id, sum(durable) as d from dur group by 1) join (select race_id, sum(passes_made) as p from pas group by 1) using (race_id) join car using (race_id)""", CAR | DURABLE | PASS)
def l20(v):
    g, car = green(v), L.green_car_laps(v.laps, v.lap_flags)
    a = L.pass_difficulty(L.durable_passes(g), "durable", car).withColumnRenamed("v", "v2")
    return r6(a.join(L.pass_difficulty(L.passes(g), "passes_made", car).withColumnRenamed("v", "v1"), "race_id"), "v1", "v2")


@query("l21_pit_importance", "entries pit_stops", """select race_id, round(vp / vs, 6) as v, e from (select race_id, count(*) as k, sum(coalesce(n, 0))::bigint as e, var_samp(coalesce(d, 0)) as vp, var_samp(start - finish) as vs from entries left join
 (select race_id, driver_id, sum(pit_in_rank - pit_out_rank) as d, count(*) as n from pit_stops where pit_out_rank is not null group by 1, 2) using (race_id, driver_id) group by 1) where k >= 3 and vs > 0 and e > 0""")
def l21(v):
    return r6(L.pit_importance(v.entries, v.pit_stops), "v")


@query("l22_pit_duration", "pit_stops", "select race_id, round(median(pit_stop_duration), 6) as v, count(*) as e from pit_stops where pit_stop_duration > 0 group by 1")
def l22(v):
    return r6(L.duration_median(v.pit_stops), "v")


WORDS = ("license", "copyright", "penalty", "speeding", "unsafe")
#: Lines of documents as notes: a note's contest stands for its document's source.
NOTES = {"notes": ("", "select doc_id, source, line as note from (select doc_id, source, unnest(string_split(text, chr(10))) as line from documents)")}


def notes(v):
    return v.table("documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("note"))


@query("l23_penalty_rate", "notes", "select source, round(avg(case when " + " or ".join(f"lower(note) like '%{w}%'" for w in WORDS) + " then 1.0::double else 0 end), 6) as v, count(*) as e from notes group by 1", NOTES)
def l23(v):
    return r6(L.word_rate(notes(v), WORDS, key="source"), "v")


PATHS = {"paths": ("pit_stops entries", """select race_id, driver_id, string_agg(n_tires || ':' || case when lap_count <= 3 then 1 when lap_count <= 6 then 2 else 4 end, ',' order by lap_count) as path
 from pit_stops join (select race_id, driver_id from entries where finish <= 10) using (race_id, driver_id) group by 1, 2"""),
 "entropy": ("paths", "select race_id, -sum(c / n * log2(c / n)) as entropy, 1 - max(c) / max(n) as nonmodal, max(n)::bigint as e from (select race_id, c::double as c, sum(c) over (partition by race_id)::double as n from (select race_id, path, count(*) as c from paths group by 1, 2)) where n >= 3 group by 1")}


def paths(v):
    stage = L.stage_bucket(F.col("lap_count"), [F.lit(3), F.lit(3), F.lit(None).cast("int"), F.lit(None).cast("int")])
    return L.strategy_paths(v.pit_stops, v.entries, stage)


@query("l24_strategy_entropy", "entropy", "select race_id, round(entropy, 6) as entropy, e from entropy", PATHS)
def l24(v):
    return r6(L.strategy_entropy(paths(v)).select("race_id", "entropy", "e"), "entropy")


@query("l25_nonmodal_share", "entropy", "select race_id, round(nonmodal, 6) as nonmodal, e from entropy", PATHS)
def l25(v):
    return r6(L.strategy_entropy(paths(v)).select("race_id", "nonmodal", "e"), "nonmodal")


@query("l26_stage_bucket", "laps", "select race_id, driver_id, lap, case when lap <= 3 then 1 when lap <= 5 then 2 when lap <= 9 then 3 else 4 end as stage from laps")
def l26(v):
    return v.laps.select("race_id", "driver_id", "lap", L.stage_bucket(F.col("lap"), [F.lit(3), F.lit(2), F.lit(4), F.lit(0)]).alias("stage"))


@query("l27_multi_entrant_notes", "", """select source, round(avg(len(ids)), 6) as v, count(*) as e from (select source, n_chars // 200 as b, list(distinct doc_id % 100) as ids from documents group by 1, 2) where len(ids) >= 3 group by 1""")
def l27(v):
    t = v.table("documents").groupBy("source", F.floor(F.col("n_chars") / 200).alias("b")).agg(F.collect_set(F.col("doc_id") % 100).alias("ids"))
    return r6(L.multi_entrant_notes(t, key="source"), "v")


@query("l28_major_loss_tail", "green entries", """select race_id, round(avg(case when finish >= best + 15 then 1.0::double else 0 end), 6) as v, count(*) as e from (select race_id, driver_id, min(running_pos) as best from green group by 1, 2)
 join entries using (race_id, driver_id) group by 1 having count(*) >= 5""")
def l28(v):
    return r6(L.major_loss_tail(green(v), v.entries), "v")


@query("l29_hhi_share", "entries", "select race_id, round(sum(pow(laps_completed / t::double, 2)), 6) as v from (select *, sum(laps_completed) over (partition by race_id) as t from entries) group by 1")
def l29(v):
    return r6(L.hhi_share(v.entries, "laps_completed"), "v")


@query("l30_hhi_fastest_laps", "green entries", """with one as (select race_id, driver_id, count(*) as n from (select *, row_number() over (partition by race_id, lap order by lap_time, driver_id) as k from green where race_id % 3 <> 0) where k = 1 group by 1, 2),
 two as (select race_id, driver_id, laps_completed as n from entries where race_id not in (select race_id from one)), u as (select * from one union all select * from two)
 select race_id, round(sum(pow(n / t::double, 2)), 6) as v from (select *, sum(n) over (partition by race_id) as t from u) group by 1""")
def l30(v):
    from ..sources.tables import fallback_union

    first = L.fastest_laps(green(v).filter("race_id % 3 <> 0"), False).withColumnRenamed("fastest_laps", "n")
    second = v.entries.select("race_id", "driver_id", F.col("laps_completed").alias("n"))
    return r6(L.hhi_share(fallback_union(first, second, ["race_id"]), "n"), "v")


@query("l31_finish_spread", "entries", "select race_id, round(stddev_samp(finish - start), 6) as sd, round(avg(case when start > 20 then 1.0::double else 0 end) filter (where finish <= 10), 6) as deep_share from entries group by 1")
def l31(v):
    return r6(L.finish_spread(v.entries), "sd", "deep_share")


@query("l32_dnf_rates", "runs", """select venue, era_key, count(*) as n, count(*) filter (where status = 'accident') as crashes, count(*) filter (where status = 'engine') as mech, round((2 + count(*) filter (where status <> 'running')) / (20 + count(*))::double, 6) as rate from runs group by 1, 2""")
def l32(v):
    return r6(L.dnf_rates(v.runs, ["venue", "era_key"]), "rate")


@query("l33_caution_taxonomy", "laps lap_flags", """select race_id, round(avg(case when returnflag in ('R', 'A') then 1.0::double else 0 end), 6) as accident_share, round(avg(case when linestatus = 'F' then 1.0::double else 0 end), 6) as beneficiary_share, count(*) as e
 from laps join lap_flags using (race_id, lap) where flag_state = 2 group by 1""")
def l33(v):
    t = v.laps.join(v.lap_flags.filter("flag_state = 2"), ["race_id", "lap"])
    shares = {"accident_share": F.col("returnflag").isin("R", "A"), "beneficiary_share": F.col("linestatus") == "F"}
    return r6(L.caution_shares(t, shares), *shares)


PREMIUM = {"parts": ("entries auto moves car pas", """select race_id, spearman, autocorr, retention, scarcity from (select race_id, case when count(*) >= 5 then corr(start, finish) end as spearman from entries group by 1)
 left join (select race_id, avg(r) as autocorr from auto group by 1) using (race_id)
 left join (select race_id, avg(case when delta <= 1 then 1.0::double else 0 end) as retention from moves join (select race_id, driver_id from (select *, count(start) over (partition by race_id) as field from entries) where start <= field / 2::double) using (race_id, driver_id) group by 1) using (race_id)
 left join (select race_id, -sum(passes_made) / max(car_laps)::double as scarcity from pas join car using (race_id) group by 1) using (race_id)"""), **AUTO, **RESTART, **CAR, **PASS}  # fmt: skip


def _z(c):
    return f"case when count({c}) over () >= 3 then ({c} - avg({c}) over ()) / stddev_pop({c}) over () end"


@query("l34_position_premium", "parts", f"""select race_id, round(list_avg([x for x in [0.5 * zs + 0.5 * za, zr, zc] if x is not null]), 6) as v from (select race_id, {_z('spearman')} as zs, {_z('autocorr')} as za, {_z('retention')} as zr, {_z('scarcity')} as zc from parts)""", PREMIUM)
def l34(v):
    g, e = green(v), v.entries
    # start and finish are permutations of a contest here, so their correlation is Spearman's
    rho = e.groupBy("race_id").agg(F.when(F.count("*") >= 5, pearson(F.col("start"), F.col("finish"))).alias("spearman"))
    auto = L.lag1_autocorr(g).groupBy("race_id").agg(F.avg("r").alias("autocorr"))
    keep = L.restart_retention(moves(v), e).select("race_id", F.col("v").alias("retention"))
    rare = L.pass_difficulty(L.passes(g), "passes_made", L.green_car_laps(v.laps, v.lap_flags)).withColumnRenamed("v", "scarcity")
    parts = rho.join(auto, "race_id", "left").join(keep, "race_id", "left").join(rare, "race_id", "left")
    return r6(L.position_premium(parts), "v")


def qis_rows(v):
    f = H.wf_features(v.runs).filter("has_pace and fin_h is not null and pace_h is not null").join(v.contests.select("race_id", "venue", "family", "era_key"), "race_id")
    every = W.partitionBy()
    z = lambda c: (F.col(c) - F.avg(c).over(every)) / F.stddev_pop(c).over(every)
    m = f.agg(F.avg("start").alias("ms"), F.stddev_pop("start").alias("ss"), F.avg("finish").alias("mf"), F.stddev_pop("finish").alias("sf"))
    t = f.join(F.broadcast(m))  # one row
    return t.withColumns({"z_start": (F.col("start") - F.col("ms")) / F.col("ss"), "z_finish": (F.col("finish") - F.col("mf")) / F.col("sf")})


from .history import FEATURES  # noqa: E402

QIS = {"qis": ("feat contests", "select f.*, venue, era_key, (start - avg(start) over ()) / stddev_pop(start) over () as z_start, (finish - avg(finish) over ()) / stddev_pop(finish) over () as z_finish from feat f join contests using (race_id) where has_pace and fin_h is not null"), **FEATURES}


@query("l35_ols_sums", "qis", """select venue, era_key, count(*) as n, round(sum(z_start), 6) as s, round(sum(z_start * z_start), 6) as ss, round(sum(z_start * fin_h), 6) as sf, round(sum(z_start * z_finish), 6) as sy, round(sum(pace_h * z_finish), 6) as py from qis group by 1, 2""", QIS)
def l35a(v):
    t = L.ols_sums(qis_rows(v), "z_finish", ["z_start", "fin_h", "pace_h"], ["venue", "era_key"])
    names = {"_1*_1": "n", "_1*z_start": "s", "z_start*z_start": "ss", "z_start*fin_h": "sf", "z_start*_y": "sy", "pace_h*_y": "py"}
    return t.select("venue", "era_key", *[(F.col(f"`{k}`").cast("long") if n == "n" else F.round(F.col(f"`{k}`"), 6)).alias(n) for k, n in names.items()])


_PAIRS = {
    "ss": ("z_start", "z_start"), "sf": ("z_start", "fin_h"), "sp": ("z_start", "pace_h"), "ff": ("fin_h", "fin_h"), "fp": ("fin_h", "pace_h"), "pp": ("pace_h", "pace_h"),
    "sy": ("z_start", "z_finish"), "fy": ("fin_h", "z_finish"), "py": ("pace_h", "z_finish"),
}
_COV = {"cov": ("qis", "select venue, era_key, count(*) as n, " + ", ".join(f"covar_pop({a}, {b}) as {m}" for m, (a, b) in _PAIRS.items()) + " from qis group by 1, 2"), **QIS}
#: The coefficient by Cramer's rule on centred cross-products.
_BETA = """case when n >= 5 then round((sy * (ff * pp - fp * fp) - sf * (fy * pp - fp * py) + sp * (fy * fp - ff * py))
 / (ss * (ff * pp - fp * fp) - sf * (sf * pp - fp * sp) + sp * (sf * fp - ff * sp)), 6) end"""


@query("l35_ols_start_effect", "cov", f"select venue, era_key, n, {_BETA} as beta from cov", _COV)
def l35(v):
    return r6(L.ols_start_effect(qis_rows(v), ["venue", "era_key"]), "beta")


_PRIOR = {"prior": ("qis", "select venue, era_key, race_seq, " + ", ".join(f"any_value({m}) as {m}" for m in ("n", *_PAIRS)) + " from (select venue, era_key, race_seq, count(*) over w as n, "
 + ", ".join(f"covar_pop({a}, {b}) over w as {m}" for m, (a, b) in _PAIRS.items()) + " from qis window w as (partition by venue, era_key order by race_seq range between unbounded preceding and 1 preceding)) group by 1, 2, 3"), **QIS}


@query("l35_ols_prior_effect", "prior", f"select venue, era_key, race_seq, n, {_BETA} as beta from prior", _PRIOR)
def l35b(v):
    return r6(L.ols_prior_effect(qis_rows(v), ["venue", "era_key"]), "beta")


CONTEND = {"cont": ("runs", """select race_id, driver_id from (select r.*, row_number() over (partition by race_id order by points desc, driver_id) as k, count(*) over (partition by race_id) as field from (
 select *, sum(greatest(0, 40 - finish)) over (partition by year, driver_id order by race_seq rows between unbounded preceding and current row) as points from runs) r
 where race_id in (select max(race_id) from runs group by year)) where k <= 4 and field >= 4""")}


def contenders(v):
    """The four best placed of each season's last contest."""
    return H.title_contenders(v.runs)


@query("l36_contender_sensitivity", "slopes cont", """select race_id, round(median(slope), 6) as all_slope, round(median(slope) filter (where c.driver_id is null), 6) as without, count(*) as n_all, count(*) filter (where c.driver_id is null) as n_without
 from slopes s left join cont c using (race_id, driver_id) where race_id in (select race_id from cont) group by 1 having count(*) >= 3 and count(*) filter (where c.driver_id is null) >= 3""", CONTEND | SLOPES)
def l36(v):
    return r6(L.median_without(slopes(v), contenders(v), "slope").withColumnRenamed("all", "all_slope"), "all_slope", "without")


@query("c24_title_contenders", "cont", "select race_id, driver_id from cont", CONTEND)
def c24(v):
    return contenders(v)


CLOCK = {"clk": ("laps", "select *, case when count(*) over w = lap and min(lap_time) over w > 0 then sum(lap_time) over w end as clock from laps window w as (partition by race_id, driver_id order by lap rows between unbounded preceding and current row)")}


@query("z04_gap_ahead", "clk", "select race_id, driver_id, lap, round(clock, 7) as clock, round(clock - lag(clock) over w, 7) as gap, clock - lag(clock) over w < 3 as dirty from clk where clock is not null window w as (partition by race_id order by clock, driver_id, lap)", CLOCK)
def z04(v):
    t = L.gap_ahead(L.elapsed_clock(v.laps.select("race_id", "driver_id", "lap", "lap_time")), most=largest(v.laps, ["race_id"]))
    return t.select("race_id", "driver_id", "lap", F.round("clock", 7).alias("clock"), F.round("gap", 7).alias("gap"), "dirty")


@query("z05_tyre_age", "laps pit_stops", """select l.race_id, l.driver_id, l.lap, l.lap - max(p.lap_count) as tyre_age from laps l left join pit_stops p on p.race_id = l.race_id and p.driver_id = l.driver_id and p.lap_count <= l.lap and p.n_tires > 0 group by 1, 2, 3""")
def z05(v):
    return L.tyre_age(v.laps, v.pit_stops).select("race_id", "driver_id", "lap", "tyre_age")
