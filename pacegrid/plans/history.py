"""Queries of the history operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import history as H
from .registry import query

R6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]

#: The prior weighted mean in its self-join form; $V value, $C condition on the earlier row, $K more key columns.
def _hl(value: str, cond: str = "true", keys: str = "", src: str = "runs") -> str:
    on = "".join(f" and h.{k} = t.{k}" for k in keys.split())
    return f"""(select sum(x.v * pow(2, -(x.nth - 1) / 8.0::double)) / sum(pow(2, -(x.nth - 1) / 8.0::double)) from (
 select {value} as v, row_number() over (order by h.race_seq desc) as nth from {src} h
 where h.driver_id = t.driver_id and h.race_seq < t.race_seq{on} and ({value}) is not null and ({cond})) x)"""


def _prior(name: str, value: str, cond: str = "true", keys: str = "", src: str = "runs") -> tuple[str, str]:
    """A table of prior means: race_id, driver_id, name, name_n."""
    on = "".join(f" and h.{k} = t.{k}" for k in keys.split())
    return src, f"""select race_id, driver_id, sum(v * pow(2, -(nth - 1) / 8.0::double)) / sum(pow(2, -(nth - 1) / 8.0::double)) as {name}, count(*) as {name}_n
 from (select t.race_id, t.driver_id, {value} as v, row_number() over (partition by t.race_id, t.driver_id order by h.race_seq desc) as nth
  from {src} t join {src} h on h.driver_id = t.driver_id and h.race_seq < t.race_seq{on} where ({value}) is not null and ({cond})) x group by 1, 2"""


FIN = {"p_fin": _prior("fin", "h.finish")}
PACE = {"p_pace": _prior("pac", "h.pace")}
TYPED = {"p_typ": _prior("typ", "h.finish", keys="ttype")}


@query("w01_race_seq", "green contests", "select race_id, driver_id, row_number() over (order by race_id) as seq from (select distinct race_id from green) join (select race_id, driver_id from green where lap = 2) using (race_id)".replace("select race_id, driver_id, row_number() over (order by race_id) as seq from (select distinct race_id from green)", "select race_id, driver_id, seq from (select race_id, row_number() over (order by race_id) as seq from (select distinct race_id from green where lap = 2))"))
def w01(v):
    green = v.laps.join(v.lap_flags.filter("flag_state = 1"), ["race_id", "lap"], "left_semi").filter("lap = 2")
    return H.race_seq(green.select("race_id", "driver_id"), ["race_id"], "seq").select("race_id", "driver_id", "seq")


@query("w02_hl_mean_prior", "runs p_fin", "select t.race_id, t.driver_id, round(fin, 6) as fin_h, coalesce(fin_n, 0) as n_hist from runs t left join p_fin using (race_id, driver_id)", FIN)
def w02(v):
    return H.hl_mean_prior(v.runs, F.col("finish"), "fin_h", ["driver_id"], ["race_seq"], count="n_hist").select("race_id", "driver_id", *R6("fin_h"), "n_hist")


@query("w03_hl_mean_prior_where", "runs p_x", "select t.race_id, t.driver_id, round(x, 6) as x_h, coalesce(x_n, 0) as n_x from runs t left join p_x using (race_id, driver_id)", {"p_x": _prior("x", "h.finish", "h.status = 'running' and h.start <= 50")})
def w03(v):
    where = (F.col("status") == "running") & (F.col("start") <= 50)
    return H.hl_mean_prior(v.runs, F.col("finish"), "x_h", ["driver_id"], ["race_seq"], where=where, count="n_x").select("race_id", "driver_id", *R6("x_h"), "n_x")


@query("w04_typed_shrunk", "runs p_fin p_typ", """select t.race_id, t.driver_id, round(case when typ_n is null then fin else (typ_n * typ + 3 * fin) / (typ_n + 3) end, 6) as typ_h,
 round(coalesce(typ, fin), 6) as typ_plain from runs t left join p_fin using (race_id, driver_id) left join p_typ using (race_id, driver_id)""", FIN | TYPED)
def w04(v):
    t = H.hl_mean_prior(v.runs, F.col("finish"), "fin_h", ["driver_id"], ["race_seq"])
    t = H.typed_shrunk(t, F.col("finish"), "fin_h", "typ_h", ["driver_id"], "ttype", ["race_seq"])
    t = H.typed_shrunk(t, F.col("finish"), "fin_h", "typ_plain", ["driver_id"], "ttype", ["race_seq"], shrink=False)
    return t.select("race_id", "driver_id", *R6("typ_h", "typ_plain"))


FEATURES = {"feat": ("runs p_fin p_pace p_typ", """select t.race_id, t.driver_id, t.race_seq, t.ttype, coalesce(fin_n, 0) as n_hist, fin as fin_h, pac as pace_h,
 case when typ_n is null then fin else (typ_n * typ + 3 * fin) / (typ_n + 3) end as typ_h,
 cast(case when start is null or start = 0 then 20 else start end as int) as start, pac is not null as has_pace, finish
 from runs t left join p_fin using (race_id, driver_id) left join p_pace using (race_id, driver_id) left join p_typ using (race_id, driver_id)"""),
 **FIN, **PACE, **TYPED}
ELIGIBLE = {"elig": ("feat", """select *, count(*) over (partition by race_id) as field from feat where n_hist >= 5 and has_pace and race_seq > 15 qualify field >= 5"""), **FEATURES}


def features(v):
    return H.wf_features(v.runs)


def eligible_rows(v):
    return H.eligible(features(v), 15, 5, 5)


@query("w05_wf_features", "feat", "select race_id, driver_id, n_hist, round(fin_h, 6) as fin_h, round(pace_h, 6) as pace_h, round(typ_h, 6) as typ_h, start, has_pace, finish from feat", FEATURES)
def w05(v):
    return features(v).select("race_id", "driver_id", "n_hist", *R6("fin_h", "pace_h", "typ_h"), "start", "has_pace", "finish")


_FORM = """select {k}, round(sum(finish * pow(2, -(nth - 1) / 8.0::double)) / sum(pow(2, -(nth - 1) / 8.0::double)), 6) as form, count(*) as n
 from (select *, row_number() over (partition by {k} order by race_seq desc) as nth from runs) group by {k}"""


@query("w06_current_form", "runs", _FORM.format(k="driver_id"))
def w06(v):
    return H.current_form(v.runs, ["driver_id"]).select("driver_id", *R6("form"), "n")


@query("w07_current_type_form", "runs", _FORM.format(k="driver_id, ttype"))
def w07(v):
    return H.current_form(v.runs, ["driver_id", "ttype"]).select("driver_id", "ttype", *R6("form"), "n")


@query("w10_z_within", "runs", """select race_id, driver_id, round((start - avg(start) over w) / (stddev_pop(start) over w + 1e-9), 6) as z_start,
 round(case when count(pace) over w < 3 then 0 else coalesce((pace - avg(pace) over w) / (stddev_pop(pace) over w + 1e-9), 0) end, 6) as z_pace from runs window w as (partition by race_id)""")
def w10(v):
    return v.runs.select("race_id", "driver_id", F.round(H.z_within(F.col("start"), ["race_id"]), 6).alias("z_start"), F.round(H.z_within(F.col("pace"), ["race_id"], True), 6).alias("z_pace"))


@query("w11_eligible", "elig", "select race_id, driver_id, n_hist, field from elig", ELIGIBLE)
def w11(v):
    return eligible_rows(v).select("race_id", "driver_id", "n_hist", "field")


#: A metric of a contest: the sample deviation of finish less start.
METRIC = {"metric": ("entries contests", "select c.race_id, c.race_seq, c.venue, c.family, c.era_key, m.value from contests c join (select race_id, stddev_samp(finish - start) as value from entries group by 1) m using (race_id)")}


def metric(v):
    m = v.entries.groupBy("race_id").agg(F.stddev_samp(F.col("finish") - F.col("start")).alias("value"))
    return v.contests.select("race_id", "race_seq", "venue", "family", "era_key").join(m, "race_id")


_SQL_AGG = {"mean": "avg({0})", "median": "median({0})", "beta": "(sum({0}) + 2) / (count({0}) + 20)"}


def _blend_sql(how: str) -> str:
    a = _SQL_AGG[how].format("value")
    return f"""select venue, family, era_key, n, n_pool, round(case when n >= 2 then (n * own + 5 * pool) / (n + 5) else pool end, 6) as value, n < 2 as backstop
 from (select venue, family, era_key, {a} as own, count(*) as n from metric group by 1, 2, 3) join (select family, era_key, {a} as pool, count(*) as n_pool from metric group by 1, 2) using (family, era_key)"""


@query("w12_profile_blend", "metric", _blend_sql("mean"), METRIC)
def w12(v):
    return H.profile_blend(metric(v), floor=2).select("venue", "family", "era_key", "n", "n_pool", *R6("value"), "backstop")


def _asof_sql(how: str) -> str:
    a = _SQL_AGG[how]
    return f"""select t.race_id, t.venue, t.family, t.era_key, count(case when p.venue = t.venue then p.value end) as n,
 round(case when count(case when p.venue = t.venue then p.value end) >= 2 then (count(case when p.venue = t.venue then p.value end) * {a.format('case when p.venue = t.venue then p.value end')} + 5 * {a.format('p.value')}) / (count(case when p.venue = t.venue then p.value end) + 5)
 when count(p.value) > 0 then {a.format('p.value')} end, 6) as value, count(case when p.venue = t.venue then p.value end) < 2 as backstop
 from metric t left join metric p on p.family = t.family and p.era_key = t.era_key and p.race_seq < t.race_seq group by 1, 2, 3, 4"""


@query("w13_profile_asof", "metric", _asof_sql("mean"), METRIC)
def w13(v):
    return H.profile_asof(metric(v), floor=2).select("race_id", "venue", "family", "era_key", "n", *R6("value"), "backstop")


@query("w14_profile_median", "metric", _blend_sql("median"), METRIC)
def w14a(v):
    return H.profile_blend(metric(v), how="median", floor=2).select("venue", "family", "era_key", "n", "n_pool", *R6("value"), "backstop")


@query("w14_profile_beta", "metric", _blend_sql("beta"), METRIC)
def w14b(v):
    return H.profile_blend(metric(v), how="beta", floor=2).select("venue", "family", "era_key", "n", "n_pool", *R6("value"), "backstop")


@query("w14_profile_median_asof", "metric", _asof_sql("median"), METRIC)
def w14c(v):
    return H.profile_asof(metric(v), how="median", floor=2).select("race_id", "venue", "family", "era_key", "n", *R6("value"), "backstop")


@query("w15_local_seq", "metric", "select venue, era_key, race_id, row_number() over (partition by venue, era_key order by race_seq) as local_seq from metric", METRIC)
def w15(v):
    return H.local_seq(metric(v), ["venue", "era_key"]).select("venue", "era_key", "race_id", "local_seq")


STAND = {"stand": ("runs", """select *, row_number() over (partition by race_id order by points desc, driver_id) as standing from (select *,
 cast(sum(greatest(0, 40 - finish)) over (partition by year, driver_id order by race_seq rows between unbounded preceding and current row) as bigint) as points from runs)"""),
 "season": ("stand", """select *, prior_standing - 16 as to_cut, n_races - race_no < 5 as in_last_wide, n_races - race_no < 3 as in_last_narrow from (
 select *, max(race_no) over (partition by year) as n_races from (select *, dense_rank() over (partition by year order by race_seq) as race_no,
 lag(standing) over (partition by year, driver_id order by race_seq) as prior_standing from stand))""")}  # fmt: skip


def season(v):
    return H.season_frame(H.standings(v.runs), 16)


@query("w16_season_frame", "season", "select race_id, driver_id, race_no, prior_standing, to_cut, in_last_wide, in_last_narrow from season", STAND)
def w16(v):
    return season(v).select("race_id", "driver_id", "race_no", "prior_standing", "to_cut", "in_last_wide", "in_last_narrow")


@query("w17_expanding_prior_mean", "runs", """select race_id, driver_id, round(avg(finish) over (partition by year, driver_id order by race_seq rows between unbounded preceding and 1 preceding), 6) as season_mean from runs""")
def w17(v):
    return H.expanding_prior_mean(v.runs, "finish", ["year", "driver_id"], "season_mean").select("race_id", "driver_id", *R6("season_mean"))


@query("w18_baseline_spike", "season", """select cohort, count(*) as n, round(avg(d), 6) as mean_d, round(median(d), 6) as median_d, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) as t from (
 select year, driver_id, avg(case when in_last_wide then finish end) - avg(case when not in_last_wide then finish end) as d,
 case when max(case when in_last_wide then prior_standing end) <= 16 then 'in' else 'out' end as cohort from season group by 1, 2) where d is not null group by 1""", STAND)
def w18(v):
    return H.baseline_spike(season(v)).select("cohort", "n", *R6("mean_d", "median_d", "t"))


@query("w19_bucket_rates", "season", """select case when abs(to_cut) <= 3 then 'near' when to_cut < 0 then 'safe' else 'far' end as bucket, count(*) as n,
 round(avg(case when status = 'accident' then 1.0::double else 0 end), 6) as crash_rate, round(avg(case when status <> 'running' then 1.0::double else 0 end), 6) as dnf_rate,
 round(corr(to_cut, case when status <> 'running' then 1 else 0 end), 6) as r from season where to_cut is not null group by 1""", STAND)
def w19(v):
    return H.bucket_rates(season(v)).select("bucket", "n", *R6("crash_rate", "dnf_rate", "r"))


@query("w20_season_length", "contests", "select year, count(*) as races, count(*) filter (where month >= 9) as playoff_races, count(*) - count(*) filter (where month >= 9) as regular_races from contests group by 1")
def w20(v):
    return H.season_length(v.contests, F.col("month") >= 9)


@query("w21_latest_board", "runs", "select race_id, driver_id, finish from runs where race_seq = (select max(race_seq) from runs) order by finish limit 21")
def w21(v):
    return H.latest_board(v.runs)


PAIRS = {"h2h": ("runs", """select t.race_id, t.driver_id, case when n_prior < 5 or met = 0 then 0.5::double else won / met::double end as win_share, n_prior, won, met from (
 select race_id, driver_id, coalesce(sum(on_) over w, 0)::bigint as n_prior, coalesce(sum(won_) over w, 0)::bigint as won, coalesce(sum(met_) over w, 0)::bigint as met from (
 select a.race_id, a.driver_id, a.race_seq, case when a.ttype <> 'SS' then 1 else 0 end as on_, case when a.ttype <> 'SS' then n - a.finish else 0 end as won_,
 case when a.ttype <> 'SS' then n - 1 else 0 end as met_ from runs a join (select race_id, count(*) as n from runs group by 1) using (race_id))
 window w as (partition by driver_id order by race_seq rows between unbounded preceding and 1 preceding)) t""")}  # fmt: skip


def win_shares(v):
    return H.pairwise_win_share_prior(v.runs, F.col("ttype") == "SS")


@query("w22_pairwise_win_share", "h2h", "select race_id, driver_id, n_prior, won, met, round(win_share, 6) as win_share from h2h", PAIRS)
def w22(v):
    return win_shares(v).select("race_id", "driver_id", "n_prior", "won", "met", *R6("win_share"))


@query("w23_pair_prob", "h2h runs", """select a.race_id, a.driver_id as a, b.driver_id as b, round(case when a.win_share = b.win_share then 0.5 else a.win_share / (a.win_share + b.win_share) end, 6) as p
 from h2h a join h2h b on a.race_id = b.race_id and a.driver_id < b.driver_id join runs x on x.race_id = a.race_id and x.driver_id = a.driver_id join runs y on y.race_id = b.race_id and y.driver_id = b.driver_id
 where x.finish + 1 = y.finish or y.finish + 1 = x.finish""", PAIRS)
def w23(v):
    return H.prior_pairs(win_shares(v)).select("race_id", "a", "b", *R6("p"))


@query("z01_flag_rates", "runs p_d p_c p_m", """select t.race_id, t.driver_id, round(d, 6) as dnf_rate_h, round(c, 6) as crash_rate_h, round(m, 6) as mech_rate_h from runs t
 left join p_d using (race_id, driver_id) left join p_c using (race_id, driver_id) left join p_m using (race_id, driver_id)""",
 {"p_d": _prior("d", "case when h.status <> 'running' then 1.0::double else 0 end"), "p_c": _prior("c", "case when h.status = 'accident' then 1.0::double else 0 end"), "p_m": _prior("m", "case when h.status = 'engine' then 1.0::double else 0 end")})
def z01(v):
    t = v.runs
    for name, on in (("dnf_rate_h", F.col("status") != "running"), ("crash_rate_h", F.col("status") == "accident"), ("mech_rate_h", F.col("status") == "engine")):
        t = H.hl_mean_prior(t, F.when(on, 1.0).otherwise(0.0), name, ["driver_id"], ["race_seq"])
    return t.select("race_id", "driver_id", *R6("dnf_rate_h", "crash_rate_h", "mech_rate_h"))


@query("z02_censored_form", "runs p_c p_fin", "select t.race_id, t.driver_id, coalesce(fin_n, 0) as n_hist, round(c, 6) as fin_cens_h from runs t left join p_fin using (race_id, driver_id) left join p_c using (race_id, driver_id)", {"p_c": _prior("c", "h.finish", "h.status = 'running'"), **FIN})
def z02(v):
    t = H.hl_mean_prior(v.runs, F.col("finish"), "fin_h", ["driver_id"], ["race_seq"], count="n_hist")
    return H.hl_mean_prior(t, F.col("finish"), "fin_cens_h", ["driver_id"], ["race_seq"], where=F.col("status") == "running").select("race_id", "driver_id", "n_hist", *R6("fin_cens_h"))


@query("z03_pool_form", "pooled p_o", "select t.race_id, t.driver_id, round(o, 6) as pool_h from pooled t left join p_o using (race_id, driver_id)",
 {"pooled": ("runs", "select *, case when count(*) over w > 1 then (sum(finish) over w - finish) / (count(*) over w - 1)::double end as others from runs window w as (partition by race_id, team_name)"), "p_o": _prior("o", "h.others", src="pooled")})
def z03(v):
    return H.pool_form_excl_self(v.runs, "team_name").select("race_id", "driver_id", *R6("pool_h"))
