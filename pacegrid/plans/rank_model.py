"""Queries of the ranking model and of rank statistics."""

from __future__ import annotations


from pyspark.sql import functions as F


from ..operators import history as H
from ..operators import block_model as B
from ..operators import rank_model as M
from ..sources.shared import materialize
from .history import ELIGIBLE, eligible_rows
from .laps import r6
from .registry import query

#: Weights for the queries that need a utility before any fit: of pace, finish, type form, start.
WEIGHTS = {"x_pace": 0.3, "x_fin": 0.2, "x_typ": 0.1, "x_start": 0.25}


def model_rows(v):
    """Eligible rows with features signed so that high is better, and a utility by fixed weights."""
    t = eligible_rows(v)
    z = {f"x_{n}": -H.z_within(F.col(c).cast("double"), ["race_id"], True) for n, c in (("pace", "pace_h"), ("fin", "fin_h"), ("typ", "typ_h"), ("start", "start"))}
    t = t.withColumns(z)
    return t.withColumn("u", M.utility(list(WEIGHTS), WEIGHTS.values()))


_Z = "-(case when count({c}) over w < 3 then 0 else coalesce(({c} - avg({c}) over w) / (stddev_pop({c}) over w + 1e-9), 0) end) as x_{n}"
ROWS = {"mrows": ("elig", "select *, 0.3::double * x_pace + 0.2::double * x_fin + 0.1::double * x_typ + 0.25::double * x_start as u from (select *, " + ", ".join(_Z.format(c=c, n=n) for n, c in (("pace", "pace_h"), ("fin", "fin_h"), ("typ", "typ_h"), ("start", "start"))) + " from elig window w as (partition by race_id))"), **ELIGIBLE}


@query("m01_pl_nll_grad", "mrows", """select round(sum(ln(s) + m - u) + 0.5 * (0.09 + 0.04 + 0.01 + 0.0625), 4) as nll, round(sum((q - 1) * x_fin) + 0.2, 4) as g_fin, round(sum((q - 1) * x_start) + 0.25, 4) as g_start from (
 select *, e * sum(1 / s) over (partition by race_id order by finish rows between unbounded preceding and current row) as q from (
 select *, sum(e) over (partition by race_id order by finish desc rows between unbounded preceding and current row) as s from (
 select *, exp(u - m) as e from (select *, max(u) over (partition by race_id) as m from mrows))))""", ROWS)
def m01(v):
    t = M.pl_terms(model_rows(v), ["x_fin", "x_start"], F.col("u"), [], piece=M.field_piece(v.entries))
    ridge = 0.5 * sum(w * w for w in WEIGHTS.values())
    return t.select(F.round(F.col("nll") + ridge, 4).alias("nll"), F.round(F.col("g_x_fin") + 2 * 0.5 * 0.2, 4).alias("g_fin"), F.round(F.col("g_x_start") + 2 * 0.5 * 0.25, 4).alias("g_start"))


def fit_rows(v):
    """What the fits of x_fin and x_start read, written once."""
    return materialize(model_rows(v).select("race_id", "finish", "x_fin", "x_start"), "fit-rows")


@query("m02_pl_fit")
def m02(v):
    return _fitted(fit_rows(v))


def _fitted(rows):
    """The weights and what is left of the gradient there; rows are read once for each step, so they are best a written table."""
    xs = ["x_fin", "x_start"]
    w = M.pl_fit(rows, xs)
    t = M.pl_terms(rows, xs, M.utility(xs, w), [])
    return t.select(*[F.lit(float(k)).alias(f"w_{x}") for x, k in zip(xs, w)], *[F.round(F.col(f"g_{x}") + F.lit(float(k)), 5).alias(f"residual_{x}") for x, k in zip(xs, w)])


@query("m02_pl_flat", "mrows", "select true as flat_fin, true as flat_start, count(*) as n from mrows", ROWS)
def m02_flat(v):
    """Whether the penalised likelihood is flat at the fitted weights, as at its least."""
    rows = fit_rows(v)
    t = _fitted(rows)
    return t.select((F.abs("residual_x_fin") < 1e-4).alias("flat_fin"), (F.abs("residual_x_start") < 1e-4).alias("flat_start")).join(rows.agg(F.count("*").alias("n")))


#: Feature sets that are compared on identical contests.
SETS = {"two": ["x_fin", "x_start"], "four": list(WEIGHTS)}


@query("m03_pl_walk_forward")
def m03(v):
    return r6(M.pl_walk_forward(model_rows(v), SETS, least=20), "u")


@query("m03_walk_forward_flat", "mrows", f"select unnest({list(SETS)}) as spec, race_seq as cut, true as flat from (select distinct race_seq from mrows order by race_seq offset 20)", ROWS)
def m03_flat(v):
    """Whether the penalised likelihood is flat at the weights of every set and cut; tests hold the weights against a plain fit."""
    t = M.walk_forward_gradient(model_rows(v), SETS, least=20)
    return t.select("spec", "cut", (F.col("gradient") < 1e-3).alias("flat"))


def next_field(v, w):
    """The last contest's entrants with enough history, by their form and start as of now, under the weights of x_fin and x_start."""
    form = H.current_form(v.runs, ["driver_id"], name="fin_h")
    last = v.contests.agg(F.max("race_id").alias("race_id"))
    field = v.entries.join(F.broadcast(last), "race_id").select("race_id", "driver_id", "start").join(form, "driver_id", "left").filter("n >= 5")
    z = field.withColumns({"x_fin": -H.z_within(F.col("fin_h"), ["race_id"], True), "x_start": -H.z_within(F.col("start").cast("double"), ["race_id"], True)})
    return M.predicted_rank(z.withColumn("u", M.utility(["x_fin", "x_start"], w))).select("race_id", "driver_id", F.round("u", 4).alias("u"), "predicted")


@query("m04_pl_score_field")
def m04(v):
    return next_field(v, M.pl_fit(fit_rows(v), ["x_fin", "x_start"]))


NEXT = {
    "now": ("runs", "select driver_id, sum(finish * pow(2, -(nth - 1) / 8.0::double)) / sum(pow(2, -(nth - 1) / 8.0::double)) as fin_h, count(*) as n from (select *, row_number() over (partition by driver_id order by race_seq desc) as nth from runs) group by 1"),
    "nextfield": ("entries contests now", "select race_id, driver_id, " + ", ".join(_Z.format(c=c, n=n) for c, n in (("fin_h", "fin"), ("start", "start"))) + " from entries join now using (driver_id) where n >= 5 and race_id = (select max(race_id) from contests) window w as (partition by race_id)"),
}


@query("m04_score_given_weights", "nextfield", "select race_id, driver_id, round(u, 4) as u, row_number() over (partition by race_id order by u desc, driver_id) as predicted from (select *, 0.2::double * x_fin + 0.25::double * x_start as u from nextfield)", NEXT)
def m04_given(v):
    """The same scores under fixed weights, which SQL can follow."""
    return next_field(v, [WEIGHTS["x_fin"], WEIGHTS["x_start"]])


RESID = {"resid": ("mrows contests", "select m.*, c.year, c.venue, c.family, finish - row_number() over (partition by race_id order by u desc, driver_id) as residual from mrows m join contests c using (race_id)"), **ROWS}


def residuals(v):
    return M.rank_residual(model_rows(v)).join(v.contests.select("race_id", "year", "venue", "family"), "race_id")


@query("m05_rank_residual", "resid", "select race_id, driver_id, residual from resid", RESID)
def m05(v):
    return residuals(v).select("race_id", "driver_id", "residual")


RHO = {"rho": ("mrows", """select race_id, ttype, max(n) as n, case when max(n) >= 3 then corr(a, b) end as rho from (select race_id, ttype, count(*) over (partition by race_id) as n,
 rank() over (partition by race_id order by start) + (count(*) over (partition by race_id, start) - 1) / 2.0::double as a, rank() over (partition by race_id order by finish) + (count(*) over (partition by race_id, finish) - 1) / 2.0::double as b from mrows) group by 1, 2"""), **ROWS}


def rho(v):
    return M.spearman_by(model_rows(v), "start", "finish", ["race_id", "ttype"])


@query("m06_spearman", "rho", "select race_id, round(rho, 6) as rho, n from rho", RHO)
def m06(v):
    return r6(rho(v).select("race_id", "rho", "n"), "rho")


@query("m07_kendall", "mrows", """select race_id, round(s / sqrt(na * nb), 6) as tau, round((s / sqrt(na * nb) + 1) / 2, 6) as accuracy from (select a.race_id, sum(sign(a.start - b.start) * sign(a.finish - b.finish))::double as s,
 sum(abs(sign(a.start - b.start)))::double as na, sum(abs(sign(a.finish - b.finish)))::double as nb from mrows a join mrows b on a.race_id = b.race_id and a.driver_id < b.driver_id group by 1)""", ROWS)
def m07(v):
    return r6(M.kendall_by(model_rows(v), "start", "finish", ["race_id"]), "tau", "accuracy")


_BANK = {"start": "start", "finish": "fin_h", "pace": "pace_h", "combined": "-(x_pace + x_fin)", "combined_typed": "-(x_pace + 0.5::double * x_fin + 0.5::double * x_typ)"}


@query("m08_predictor_bank", "mrows", " union all ".join(f"""select race_id, '{n}' as predictor, round(corr(a, b), 6) as rho from (select race_id, rank() over (partition by race_id order by p) + (count(*) over (partition by race_id, p) - 1) / 2.0::double as a, finish_rank as b
 from (select race_id, round({e}, 9) as p, rank() over (partition by race_id order by finish) as finish_rank from mrows)) group by race_id""" for n, e in _BANK.items()), ROWS)
def m08(v):
    bank = {n: F.expr(e.replace("::double", "D")) for n, e in _BANK.items()}
    return r6(M.predictor_bank(model_rows(v), bank).select("race_id", "predictor", "rho"), "rho")


PAIRED = {"paired": ("mrows", """select race_id, round(c1 - c2, 6) as d from (select race_id, corr(rank_start, finish_rank) as c1, corr(rank_fin, finish_rank) as c2 from (select race_id,
 rank() over (partition by race_id order by start) + (count(*) over (partition by race_id, start) - 1) / 2.0::double as rank_start,
 rank() over (partition by race_id order by round(fin_h, 9)) + (count(*) over (partition by race_id, round(fin_h, 9)) - 1) / 2.0::double as rank_fin, rank() over (partition by race_id order by finish) as finish_rank from mrows) group by 1)"""), **ROWS}


def paired(v):
    t = materialize(model_rows(v).select("race_id", "start", "finish", F.round("fin_h", 9).alias("fin9")), "paired")
    a = M.spearman_by(t, "start", "finish", ["race_id"]).select("race_id", F.col("rho").alias("c1"))
    b = M.spearman_by(t, "fin9", "finish", ["race_id"]).select("race_id", F.col("rho").alias("c2"))
    return a.join(b, "race_id").select("race_id", F.round(F.col("c1") - F.col("c2"), 6).alias("d"))


SIGNED = {"signed": ("paired", """select n, w_plus, w_minus, round((w_plus - n * (n + 1) / 4.0::double) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::double - ties / 48.0::double), 6) as z from (
 select count(*) as n, coalesce(sum(r) filter (where d > 0), 0) as w_plus, coalesce(sum(r) filter (where d < 0), 0) as w_minus from (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0::double as r from paired where d <> 0)),
 (select sum(c * c * c - c) as ties from (select count(*) as c from paired where d <> 0 group by abs(d)))"""), **PAIRED}


#: p of the signed ranks: over 50 pairs the normal tail by Simpson's rule, else the counts of rank sums over 2^n.
TAIL = {"curve": ("signed", "select (w_plus - n * (n + 1) / 4.0::double - 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::double) as low from signed"),
 "normal": ("curve", """select sum((case when i in (0, 6000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-pow(low + i * 0.005::double, 2) / 2)) * 0.005::double / 3 / sqrt(2 * pi()) as p from curve, range(6001) r(i)"""),
 "exact": ("signed", """with recursive w(k, ways) as (select 0::bigint, [case when s = 0 then 1.0::double else 0.0::double end for s in range(0, n * (n + 1) // 2 + 1)] from signed where n between 1 and 50
  union all select k + 1, [ways[s + 1] + case when s > k then ways[s - k] else 0.0::double end for s in range(0, len(ways))] from w, signed where k < n)
 select list_sum(ways[ceil(w_plus)::bigint + 1 :]) / pow(2, n) as p from w, signed where k = n"""),
 "tail": ("signed normal exact", "select *, case when n > 50 then (select p from normal) when n = 0 then 1.0::double else (select p from exact) end as p from signed"), **SIGNED}


@query("m09_wilcoxon", "tail", "select n, round(w_plus, 6) as w_plus, round(w_minus, 6) as w_minus, z, round(p, 6) as p from tail", TAIL)
def m09(v):
    return r6(M.wilcoxon(paired(v), F.col("d")).select("n", "w_plus", "w_minus", "z", "p"), "w_plus", "w_minus", "z", "p")


@query("z06_paired_gate", "paired tail", """select n, z, round(p, 6) as p, round(avg_d, 6) as mean_d, avg_d >= 0.005 as lifts, case when p <= 0.0167 and avg_d >= 0.005 then 'adopt' else 'keep' end as verdict
 from tail, (select avg(d) as avg_d from paired)""", TAIL)
def z06(v):
    return r6(M.paired_gate(paired(v), F.col("d")), "z", "p", "mean_d")


_U = "(('0x' || substr(md5({k}), 1, 13))::ubigint)::double / 4503599627370496.0::double"
CI = {"ci": ("rho", f"""select g.ttype, g.mean, g.n, b.lo, b.hi from (select ttype, avg(rho) as mean, count(*) as n from rho group by 1) g join (select ttype, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from (
 select d.ttype, rep, avg(rho) as m from (select ttype, n, rep, floor({_U.format(k="ttype || '|' || rep || '|' || draw || '|1'")} * n)::int as i from (select ttype, count(*) as n from rho group by 1), range(500) r(rep), range(100) s(draw) where draw < n) d
 join (select ttype, rho, row_number() over (partition by ttype order by race_id) - 1 as i from rho) x on x.ttype = d.ttype and x.i = d.i group by 1, 2) group by 1) b using (ttype)"""), **RHO}


@query("m10_bootstrap_mean_ci", "ci", "select ttype, round(mean, 6) as mean, n, round(lo, 6) as lo, round(hi, 6) as hi from ci", CI)
def m10(v):
    return r6(M.bootstrap_mean_ci(rho(v).drop("n"), "rho", "race_id", "ttype", reps=500), "mean", "lo", "hi")


@query("m11_two_sample", "runs", """select n1, n2, round(mean / (sd / sqrt(n1)), 6) as t, (select round(greatest(0, 1 - 2 * sum((case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end) * pow(1 + pow(i / 4000.0::double * far, 2) / df, -(df + 1) / 2.0::double)) * far / 12000
  * exp(lgamma((df + 1) / 2.0::double) - lgamma(df / 2.0::double)) / sqrt(df * pi())), 6) from (select abs(mean / (sd / sqrt(n1))) as far, (n1 - 1)::double as df), range(4001) r(i) group by far, df) as p, round(r1 - n1 * (n1 + 1) / 2.0::double, 6) as u, round((r1 - n1 * (n1 + 1) / 2.0::double - n1 * n2 / 2.0::double) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0::double), 6) as z from (
 select count(*) filter (where f) as n1, count(*) filter (where not f) as n2, sum(r) filter (where f) as r1, avg(d) filter (where f) as mean, stddev_samp(d) filter (where f) as sd from (
 select start - finish as d, month >= 9 as f, rank() over (order by start - finish) + (count(*) over (partition by start - finish) - 1) / 2.0::double as r from runs))""")
def m11(v):
    t = v.runs.select((F.col("start") - F.col("finish")).alias("d"), (F.col("month") >= 9).alias("f"))
    return r6(M.two_sample(t, "d", "f").select("n1", "n2", "t", "p", "u", "z"), "t", "p", "u", "z")


VALUES, HALF_LIVES, BURNS, LEAST = ["finish", "start", "laps_completed", "gain"], [2, 4, 8, 16], [10, 15], [1, 5]
#: The prior mean in its self-join form, of every value and half-life; gain is start less finish.
GRID = {
 "gridrows": ("runs", "select *, start - finish as gain from runs"),
 "priors": ("gridrows", " union all ".join(f"""select race_id, race_seq, finish, '{c}' as value, {hl} as half_life, round(sum(v * pow(2, -(nth - 1) / {hl}.0::double)) / sum(pow(2, -(nth - 1) / {hl}.0::double)), 9) as f, count(*) as k
  from (select t.race_id, t.race_seq, t.driver_id, t.finish, h.{c} as v, row_number() over (partition by t.race_id, t.driver_id order by h.race_seq desc) as nth from gridrows t join gridrows h on h.driver_id = t.driver_id and h.race_seq < t.race_seq)
  group by race_id, race_seq, driver_id, finish""" for c in VALUES for hl in HALF_LIVES)),
}


@query("m12_config_grid", "priors", f"""select value, half_life, burn, least, round(avg(rho), 6) as mean_rho, count(*) as n from (select value, half_life, burn, least, race_id, corr(a, b) as rho from (
 select *, rank() over (w order by f) + (count(*) over (partition by value, half_life, burn, least, race_id, f) - 1) / 2.0::double as a, rank() over (w order by finish) as b
 from priors, (select unnest({BURNS}) as burn), (select unnest({LEAST}) as least) where race_seq > burn and k >= least window w as (partition by value, half_life, burn, least, race_id))
 group by all having count(*) >= 5) group by all""", GRID)
def m12(v):
    rows = v.entries.join(v.contests.select("race_id", "race_seq"), "race_id").withColumn("gain", F.col("start") - F.col("finish"))  # no pace is needed
    return r6(M.config_grid(rows, VALUES, HALF_LIVES, BURNS, LEAST), "mean_rho")


@query("m13_by_type_summary", "rho", """select ttype, count(rho) as n, round(avg(rho), 6) as mean, round(stddev_samp(rho), 6) as sd, round(stddev_samp(rho) / sqrt(count(rho)), 6) as se,
 round(avg(case when rho > 0 then 1.0::double else 0 end), 6) as positive, round(avg(rho) - (select avg(rho) from rho), 6) as over_all from rho where rho is not null group by 1""", RHO)
def m13(v):
    return r6(M.by_type_summary(rho(v).select("ttype", "rho")), "mean", "sd", "se", "positive", "over_all")


FACTORS = {"driver_id": 3.0, "team_name": 10.0, "make": 30.0}
LAMBDAS = [0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0]


def block_fit(v):
    return B.block_pl_fit(v.entries, list(FACTORS), FACTORS)


@query("m14_block_pl_fit")
def m14(v):
    return r6(block_fit(v).select("factor", "entity", "worth"), "worth")


@query("m14_block_pl_flat", "entries", " union all ".join(f"select distinct '{f}' as factor, {f}::varchar as entity, 0.0::double as gradient from entries" for f in FACTORS))
def m14_flat(v):
    """The gradient of the penalised likelihood at the fitted worths, taken anew by window functions, to two places."""
    g = B.block_gradient(v.entries, list(FACTORS), block_fit(v), FACTORS)
    return g.select("factor", "entity", F.abs(F.round("gradient", 2)).alias("gradient"))


@query("m15_cv_select_lambda")
def m15(v):
    rows = v.runs.select("race_id", "driver_id", "finish", "year", "team_name", "make")
    best = B.cv_select_lambda(rows, list(FACTORS), LAMBDAS)
    return rows.limit(1).select(*[F.lit(x).alias(f"lam_{f}") for f, x in best.items()])


#: The two variants of the entries: all, and those still running at the end.
VARIANTS = {"primary": "true", "dnf_excluded": "status = 'running'"}


@query("m16_variance_shares", "entries", " union all ".join(f"""select '{n}' as variant, factor, lam, round(sqrt(1 / (2 * lam)), 6) as sd, round((1 / (2 * lam)) / sum(1 / (2 * lam)) over (), 6) as share, n,
 case when factor = 'team_name' and '{n}' = 'primary' then (1 / (2 * lam)) / sum(1 / (2 * lam)) over () >= 0.2 end as "trigger" from ("""
 + " union all ".join(f"select '{f}' as factor, {x}::double as lam, count(distinct {f}) as n from entries where {c}" for f, x in FACTORS.items()) + ")" for n, c in VARIANTS.items()))
def m16(v):
    lam = v.spark.createDataFrame(list(FACTORS.items()), "factor string, lam double")
    both = None
    for name, cond in VARIANTS.items():
        rows = v.entries.filter(cond)
        own = None
        for f in FACTORS:  # the shares need each factor's entities alone
            t = rows.select(F.lit(f).alias("factor"), F.col(f).cast("string").alias("entity"), F.lit(0.0).alias("worth")).distinct()
            own = t if own is None else own.unionByName(t)
        s = M.variance_shares(lam, own).withColumn("variant", F.lit(name))
        s = s.withColumn("trigger", F.when(F.lit(name) == "primary", F.col("trigger")))
        both = s if both is None else both.unionByName(s)
    return r6(both.select("variant", "factor", "lam", "sd", "share", "n", "trigger"), "sd", "share")


@query("m16_empirical_spread")
def m16_empirical(v):
    """The deviation of the fitted worths by factor, of all entries and of the finishers only, beside what the ridge weights say."""
    lam, both = v.spark.createDataFrame(list(FACTORS.items()), "factor string, lam double"), None
    for name, cond in VARIANTS.items():
        s = M.variance_shares(lam, B.block_pl_fit(v.entries.filter(cond), list(FACTORS), FACTORS)).select(F.lit(name).alias("variant"), "factor", "sd", "sd_empirical", "share", "n")
        both = s if both is None else both.unionByName(s)
    return r6(both, "sd", "sd_empirical", "share")


@query("m17_strong_components", "entries", """with recursive e as (select distinct a, b from (select node as a, lead(node) over (partition by race_id order by finish) as b from (select *, race_id // 100 || ':' || team_name as node from entries)) where b is not null and a <> b),
 r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b), n as (select a as node from e union select b from e)
 select node, least(node, coalesce(min(x.b), node)) as component from n left join (select r.a, r.b from r join r s on s.a = r.b and s.b = r.a) x on x.a = n.node group by node""")
def m17(v):
    named = v.entries.withColumn("node", F.concat_ws(":", F.floor(F.col("race_id") / 100), "team_name"))
    return M.strong_components(M.ahead_edges(named, "node"))


@query("m17_connectivity", "runs", """with recursive t as (select race_id, finish, w.w as win, f.f, case f.f when 'driver_id' then driver_id::varchar when 'team_name' then team_name else make end as e
  from runs, (select unnest(['driver_id', 'team_name', 'make']) as f) f, lateral (select unnest(['pooled', year::varchar]) as w) w),
 ids as (select win, f, e, row_number() over (order by win, f, e) as k from (select distinct win, f, e from t)),
 edge as (select distinct x.k as a, y.k as b from (select win, f, e, lead(e) over (partition by race_id, win, f order by finish) as nxt from t) z join ids x on x.win = z.win and x.f = z.f and x.e = z.e join ids y on y.win = z.win and y.f = z.f and y.e = z.nxt where z.nxt <> z.e),
 reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on e.a = r.b),
 comp as (select ids.*, least(k, coalesce(c.low, k)) as c from ids left join (select x.a, min(x.b) as low from reach x join reach y on y.a = x.b and y.b = x.a group by 1) c on c.a = ids.k),
 sizes as (select win, f, c, count(*) as n, min(e) as first from comp group by 1, 2, 3),
 heads as (select win, f, sum(n)::bigint as n_entities, count(*) as n_components, arg_min(c, (-n, first)) as g from sizes group by 1, 2)
 select win as "window", f as factor, n_entities, n_components, n_components = 1 as connected, (select string_agg(e, ',' order by e) from comp where comp.win = heads.win and comp.f = heads.f and comp.c <> heads.g) as outside from heads""")
def m17_report(v):
    return M.connectivity(v.runs, list(FACTORS), "year")


@query("m18_weighted_pearson", "resid", """select venue, case when vx > 1e-12 and vy > 1e-12 then round((sxy / sw - mx * my) / sqrt(vx * vy), 5) end as r from (select venue, sum(w) as sw, sum(w * x * y) as sxy, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my,
 sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2) as vx, sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2) as vy from (select venue, fin_h as x, residual::double as y, n_hist::double as w from resid) group by 1)""", RESID)
def m18(v):
    t = residuals(v).groupBy("venue").agg(M.weighted_pearson(F.col("fin_h"), F.col("residual").cast("double"), F.col("n_hist").cast("double")).alias("r"))
    return t.select("venue", F.round("r", 5).alias("r"))


SIM = {"cell": ("resid", "select venue, driver_id, year, sum(residual)::double as s, count(*) as n from resid group by 1, 2, 3"),
 "tot": ("cell", "select venue, driver_id, sum(s) as ts, sum(n)::bigint as tn from cell group by 1, 2"),
 "foldm": ("tot cell resid", "select t.venue, t.driver_id, y.year, (ts - coalesce(s, 0)) / (tn - coalesce(n, 0)) as m, tn - coalesce(n, 0) as k from tot t cross join (select distinct year from resid) y left join cell c on c.venue = t.venue and c.driver_id = t.driver_id and c.year = y.year where tn - coalesce(n, 0) > 0"),
 "fold2": ("foldm", """select a, b, year, case when cnt >= 3 and vx > 1e-12 and vy > 1e-12 then (sxy - mx * my) / sqrt(vx * vy) end as r from (select a, b, year, count(*) as cnt, sum(w * x * y) / sum(w) as sxy, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my,
  sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2) as vx, sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2) as vy from (select p.venue as a, q.venue as b, p.year, p.m as x, q.m as y, least(p.k, q.k)::double as w from foldm p join foldm q on p.driver_id = q.driver_id and p.year = q.year and p.venue < q.venue) group by 1, 2, 3)"""),
 "sim": ("fold2 tot", """select a, b, sim, fold_sd, folds, overlap, weight from (select a, b, avg(r) as sim, stddev_pop(r) as fold_sd, count(r) as folds from fold2 group by 1, 2) join (select p.venue as a, q.venue as b, count(*) as overlap, sum(least(p.tn, q.tn))::bigint as weight from tot p join tot q on p.driver_id = q.driver_id and p.venue < q.venue group by 1, 2) using (a, b)"""),
 **RESID}


def similarity(v):
    return M.venue_pair_similarity(residuals(v))


@query("m19_venue_pair_similarity", "sim", "select a, b, round(sim, 5) as sim, round(fold_sd, 5) as fold_sd, folds, overlap, weight from sim", SIM)
def m19(v):
    return similarity(v).select("a", "b", F.round("sim", 5).alias("sim"), F.round("fold_sd", 5).alias("fold_sd"), "folds", "overlap", "weight")


BLEND = {"held": ("resid", "select venue, count(distinct race_id) as n from resid group by 1"), "fam": ("sim contests", "select s.*, least(x.family, y.family) as fa, greatest(x.family, y.family) as fb from sim s join (select distinct venue, family from contests) x on x.venue = s.a join (select distinct venue, family from contests) y on y.venue = s.b"), **SIM}


@query("m20_pair_blend", "fam held", """select a, b, met, round(case when met then (weight * sim + 5 * pool) / (weight + 5) else pool end, 5) as value
 from (select fam.*, coalesce(overlap >= 5 and weight >= 10 and sim is not null, false) and coalesce(least(x.n, y.n), 0) >= 6 as met from fam left join held x on x.venue = fam.a left join held y on y.venue = fam.b) join (select fa, fb, avg(sim) as pool from fam group by 1, 2) using (fa, fb)""", BLEND)
def m20(v):
    held = residuals(v).groupBy("venue").agg(F.countDistinct("race_id").alias("n"))
    t = M.pair_blend(similarity(v), v.contests.select("venue", "family").distinct(), held, sides=6)
    return t.select("a", "b", "met", F.round("value", 5).alias("value"))


NEAR = {"near": ("sim", "select venue, other, sim, row_number() over (partition by venue order by round(sim, 9) desc, other) as rank, count(*) over (partition by venue) as n from (select a as venue, b as other, sim from sim union all select b, a, sim from sim) where sim is not null"), **SIM}


def near(v):
    return M.neighbours(similarity(v).withColumn("sim", F.round("sim", 9)))


@query("m21_neighbours", "near", "select venue, other, rank, rank <= 3 as top, rank > n / 2.0::double as bottom_half from near", NEAR)
def m21(v):
    return near(v).select("venue", "other", "rank", "top", "bottom_half")


#: Structural edges: each venue to the next three by number.
EDGES = {"edges": ("contests", "select x.venue as source, y.venue as target, (substr(y.venue, 2)::int - substr(x.venue, 2)::int) as rank from (select distinct venue from contests) x join (select distinct venue from contests) y on substr(y.venue, 2)::int - substr(x.venue, 2)::int between 1 and 3"), **NEAR}


def edges(v):
    venues = v.contests.select("venue", "month").distinct()
    o = venues.select(F.col("venue").alias("target"), F.col("month").alias("m2"))
    return venues.join(o, (F.col("m2") - F.col("month")).between(1, 3)).select(F.col("venue").alias("source"), "target", (F.col("m2") - F.col("month")).alias("rank"))


@query("m22_edge_disagreements", "edges near", """select venue as source, other as target, 1 as kind from near join edges on source = venue and target = other where near.rank > n / 2.0::double
 union all select venue, other, 2 from near where near.rank <= 3 and not exists (select 1 from edges where source = venue and target = other)""", EDGES)
def m22(v):
    return M.edge_disagreements(near(v), edges(v))


@query("m23_edge_agreement", "edges near", """select venue, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double, 6) as jaccard from (select source as venue, list(target) as a from edges group by 1) join (select venue, list(other) as b from near where rank <= 3 group by 1) using (venue)""", EDGES)
def m23(v):
    return r6(M.edge_agreement(near(v), edges(v)), "jaccard")


@query("m23_edge_spearman", "edges sim", """select n, round(case when n >= 3 then rho end, 6) as rho from (select count(*) as n, corr(x, y) as rho from (
 select rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as x, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as y
 from (select 4 - e.rank as score, round(p.sim, 9) as s from edges e join sim p on p.a = least(e.source, e.target) and p.b = greatest(e.source, e.target) where p.sim is not null)))""", EDGES)
def m23_spearman(v):
    pairs = similarity(v).withColumn("sim", F.round("sim", 9))
    return r6(M.edge_spearman(pairs, edges(v).withColumn("score", 4 - F.col("rank"))), "rho")


COVS = {"covs": ("entries contests", "select venue, name, value from (select venue, avg(laps_completed) as laps, count(*)::double / count(distinct race_id) as field from entries join contests using (race_id) group by 1) unpivot (value for name in (laps, field))")}
CUTS = {"gains": ("covs sim", """with c as (select venue, name, round(value, 6) as value from covs), s as (select c.name, t.threshold, c.venue, c.value <= t.threshold as lft from c join (select distinct name, value as threshold from c) t on t.name = c.name)
 select g.name, g.threshold, n_left, n_right, wl + wr - bt as gain from (select x.name, x.threshold, avg(sim) filter (where x.lft and y.lft) as wl, avg(sim) filter (where not x.lft and not y.lft) as wr, avg(sim) filter (where x.lft <> y.lft) as bt
 from sim p join s x on x.venue = p.a join s y on y.venue = p.b and y.name = x.name and y.threshold = x.threshold where sim is not null group by 1, 2) g join (select name, threshold, count(*) filter (where lft) as n_left, count(*) filter (where not lft) as n_right from s group by 1, 2) z on z.name = g.name and z.threshold = g.threshold where least(n_left, n_right) >= 3"""), **COVS, **SIM}


def covariates(v):
    t = v.entries.join(v.contests.select("race_id", "venue"), "race_id").groupBy("venue").agg(F.avg("laps_completed").alias("laps"), (F.count("*") / F.countDistinct("race_id")).alias("field"))
    return t.unpivot("venue", ["laps", "field"], "name", "value").withColumn("value", F.round("value", 6))


@query("m24_best_partition", "gains", "select name, round(threshold, 6) as threshold, n_left, n_right, round(gain, 5) as gain from gains", CUTS)
def m24(v):
    t = M.best_partition(similarity(v).select("a", "b", "sim"), covariates(v))
    return t.select("name", F.round("threshold", 6).alias("threshold"), "n_left", "n_right", F.round("gain", 5).alias("gain"))


#: A level of the tree in SQL: candidates, their gains, the best of each node, and where its venues go.
_LEVEL = """{n}v as (select t.node, t.venue, name, value, count(distinct t.venue) over (partition by t.node, name) as k, m from (select *, count(*) over (partition by node) as m from {at} where node >= {lo}) t join c on c.venue = t.venue where m >= 6),
 {n}s as (select v.node, v.name, x.threshold, v.venue, v.value <= x.threshold as lft from {n}v v join (select node, name, (value + lead(value) over (partition by node, name order by value)) / 2 as threshold from (select distinct node, name, value from {n}v where k = m)) x on x.node = v.node and x.name = v.name where x.threshold is not null),
 {n}g as (select a.node, a.name, a.threshold, avg(sim) filter (where a.lft and b.lft) + avg(sim) filter (where not a.lft and not b.lft) - avg(sim) filter (where a.lft <> b.lft) as gain from sim p join {n}s a on a.venue = p.a join {n}s b on b.venue = p.b and b.node = a.node and b.name = a.name and b.threshold = a.threshold where sim is not null group by 1, 2, 3),
 {n} as (select g.node, arg_min((g.name, g.threshold, n_left, n_right, round(gain, 9)), (-round(gain, 9), g.name, g.threshold)) as x from {n}g g join (select node, name, threshold, count(*) filter (where lft) as n_left, count(*) filter (where not lft) as n_right from {n}s group by 1, 2, 3) z on z.node = g.node and z.name = g.name and z.threshold = g.threshold
  where least(n_left, n_right) >= 3 and round(gain, 9) > 0 group by 1),
 {to} as (select t.venue, case when s.node is null then t.node else 2 * t.node + case when c.value <= s.x[2] then 0 else 1 end end as node from {at} t left join {n} s on s.node = t.node left join c on c.venue = t.venue and c.name = s.x[1])"""
_TREE = "with c as (select venue, name, round(value, 6) as value from covs), at0 as (select distinct venue, 1::bigint as node from c), " + ", ".join(_LEVEL.format(n=f"s{k}", at=f"at{k}", to=f"at{k + 1}", lo=2**k) for k in range(3))


def tree(v):
    return M.partition_tree(similarity(v).select("a", "b", "sim"), covariates(v))


@query("m24_partition_tree", "covs sim", _TREE + " " + " union all ".join(f"select node, {k} as depth, x[1] as name, round(x[2], 6) as threshold, x[3] as n_left, x[4] as n_right, round(x[5], 5) as gain from s{k}" for k in range(3)), CUTS)
def m24_tree(v):
    t = tree(v)[1]
    return t.select("node", "depth", "name", F.round("threshold", 6).alias("threshold"), "n_left", "n_right", F.round("gain", 5).alias("gain"))


@query("m25_leaf_labels", "covs sim contests", _TREE + """, l as (select at3.venue, node as leaf, ttype as label from at3 left join (select distinct venue, ttype from contests) x on x.venue = at3.venue)
 select venue, leaf, size, majority, label, label = majority as agrees from l join (select leaf, count(distinct venue) as size from l group by 1) s using (leaf)
 left join (select leaf, arg_min(label, (-n, label)) as majority from (select leaf, label, count(*) as n from l where label is not null group by 1, 2) group by 1) m using (leaf)""", CUTS)
def m25_labels(v):
    return M.leaf_labels(tree(v)[0], v.contests.select("venue", F.col("ttype").alias("label")).distinct())


@query("m25_leaf_agreement", "runs", """with c as (select family as leaf, ttype as label, count(*) as c from runs group by 1, 2), t as (select (select sum(c * (c - 1) / 2.0::double) from c) as ij, (select sum(c)::double from c) as n,
 (select sum(r * (r - 1) / 2.0::double) from (select sum(c) as r from c group by leaf)) as i, (select sum(r * (r - 1) / 2.0::double) from (select sum(c) as r from c group by label)) as j, (select sum(m)::double from (select max(c) as m from c group by leaf)) as m)
 select round(m / n, 6) as purity, round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) as ari from t""")
def m25(v):
    return r6(M.leaf_agreement(v.runs, "family", "ttype"), "purity", "ari")


@query("m26_spec_trio", "rho", "select round(avg(rho), 6) as backtest, round(avg(rho) filter (where ttype <> 'SS'), 6) as without_excluded, round(avg(rho) filter (where race_id >= 200100), 6) as held_out from rho", RHO)
def m26(v):
    return r6(M.spec_trio(rho(v), F.col("ttype") == "SS", F.col("race_id") >= 200100), "backtest", "without_excluded", "held_out")


