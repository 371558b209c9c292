"""A Plackett-Luce ranking model with linear utilities, and rank statistics (rows M01-M26). Utilities are high for better."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.inversions import PIECE, pair_counts, tied_pairs
from ..functions.ranks import ranked
from ..functions.stats import avg_rank, pearson, safe_div, signed_rank_sf, student_sf, uniform
from ..sources.shared import materialize
from .block_model import block_pl_fit  # noqa: F401


def _running(t: DataFrame, parts: dict[str, Column], race: list[str]) -> DataFrame:
    """_m, the contest's largest utility, _e = exp(u - m), its running sums from behind times each of `parts`, and _q, e times the sum of
    1 / S so far; a contest is one window."""
    back = W.partitionBy(*race).orderBy(F.desc("finish")).rowsBetween(W.unboundedPreceding, 0)
    fore = W.partitionBy(*race).orderBy("finish").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("_m", F.max("_u").over(W.partitionBy(*race))).withColumn("_e", F.exp(F.col("_u") - F.col("_m")))
    t = t.withColumns({c: F.sum(F.col("_e") * x).over(back) for c, x in parts.items()})
    return t.withColumn("_q", F.col("_e") * F.sum(1 / F.col("_S")).over(fore))


def _running_in_pieces(t: DataFrame, parts: dict[str, Column], race: list[str], piece: int) -> DataFrame:
    """The columns of `_running` where a contest is cut at every `piece` places: sums inside a segment, shifted by its own largest utility,
    and a row a segment with what those behind it (for 1 / S, those before it) add up to. Windows, sums and joins go by contest and segment."""
    part = [*race, "_segment"]
    inside, of_race = W.partitionBy(*part), W.partitionBy(*race)
    back = inside.orderBy(F.desc("finish")).rowsBetween(W.unboundedPreceding, 0)
    fore = inside.orderBy("finish").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("_segment", F.floor((F.col("finish") - 1) / F.lit(piece)))
    t = t.withColumn("_top", F.max("_u").over(inside)).withColumn("_e", F.exp(F.col("_u") - F.col("_top")))
    ends = t.groupBy(*part).agg(F.max("_top").alias("_t"), *[F.sum(F.col("_e") * x).alias(f"{c}_all") for c, x in parts.items()])
    ends = ends.withColumn("_m", F.max("_t").over(of_race)).withColumn("_scale", F.exp(F.col("_t") - F.col("_m")))
    behind = of_race.orderBy(F.desc("_segment")).rowsBetween(W.unboundedPreceding, -1)
    more = [F.coalesce(F.sum(F.col(f"{c}_all") * F.col("_scale")).over(behind), F.lit(0.0)).alias(f"{c}_more") for c in parts]
    t = t.withColumns({c: F.sum(F.col("_e") * x).over(back) for c, x in parts.items()}).join(ends.select(*part, "_m", "_scale", *more), part)
    t = t.withColumns({"_e": F.col("_e") * F.col("_scale"), **{c: F.col(c) * F.col("_scale") + F.col(f"{c}_more") for c in parts}})
    before = of_race.orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    sums = t.groupBy(*part).agg(F.sum(1 / F.col("_S")).alias("_inverse"))
    sums = sums.select(*part, F.coalesce(F.sum("_inverse").over(before), F.lit(0.0)).alias("_passed"))
    t = t.withColumn("_so_far", F.sum(1 / F.col("_S")).over(fore)).join(sums, part)
    return t.withColumn("_q", F.col("_e") * (F.col("_so_far") + F.col("_passed")))


def pl_terms(rows: DataFrame, xs: list[str], u: Column, keys: list[str], hessian: bool = False, piece: int | None = None) -> DataFrame:
    """M01, per key: nll (sum over ranks of log S - u), gradient g_<x>, and Hessian h_<x>_<y>, without the ridge.

    rows hold one entrant of one contest each, with its finish. S is the sum of exp(u) over the entrant and those behind
    it: a running sum in reverse finish order, after a shift by the contest's largest u; q the prefix sum of 1 / S.
    piece: how many places of a contest one task takes; none: a contest is one window. `field_piece` tells which is due."""
    race = [*keys, "race_id"]
    t, parts = rows.withColumn("_u", u), {"_S": F.lit(1.0), **({f"_b_{x}": F.col(x) for x in xs} if hessian else {})}
    t = _running(t, parts, race) if piece is None else _running_in_pieces(t, parts, race, piece)
    aggs = [F.sum(F.log("_S") + F.col("_m") - F.col("_u")).alias("nll")]
    aggs += [F.sum((F.col("_q") - 1) * F.col(x)).alias(f"g_{x}") for x in xs]
    if hessian:
        aggs += [F.sum(F.col("_q") * F.col(a) * F.col(b) - F.col(f"_b_{a}") * F.col(f"_b_{b}") / (F.col("_S") * F.col("_S"))).alias(f"h_{a}_{b}") for i, a in enumerate(xs) for b in xs[i:]]
    return t.groupBy(*keys).agg(*aggs) if keys else t.agg(*aggs)


def field_piece(entries: DataFrame, piece: int = PIECE) -> int | None:
    """`piece` if some contest has more places than that, else none: contests are windows of their own then."""
    return piece if (entries.agg(F.max("finish")).first()[0] or 0) > piece else None


def utility(xs: list[str], w) -> Column:
    return sum((F.lit(float(k)) * F.col(x) for x, k in zip(xs, w)), F.lit(0.0))


def _newton_step(r, xs: list[str], w: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    g = np.array([r[f"g_{x}"] for x in xs]) + 2 * ridge * w
    h = np.array([[r[f"h_{xs[min(i, j)]}_{xs[max(i, j)]}"] for j in range(len(xs))] for i in range(len(xs))]) + 2 * ridge * np.eye(len(xs))
    return np.linalg.solve(h, g), float(np.abs(g).max())


def _flat(size: float, before: float, value: float, tol: float) -> bool:
    """Whether a gradient is as small as it gets: under `tol`, whatever the number of contests, or, small beside the value, no longer falling."""
    return size < tol or (size < 1e-8 * abs(value) and size > before / 2)


def pl_fit(rows: DataFrame, xs: list[str], ridge: float = 0.5, tol: float = 1e-6, most: int = 25) -> np.ndarray:
    """M02. The weights of least ridge-penalised nll, by Newton's method; each step is one aggregate over all contests, and
    the driver solves a system of len(xs)."""
    rows, w, before = rows.select("race_id", "finish", *xs).persist(), np.zeros(len(xs)), np.inf
    try:
        step, piece, size = np.zeros(len(xs)), field_piece(rows), np.inf
        for _ in range(most):
            r = pl_terms(rows, xs, utility(xs, w), [], True, piece).first()
            if r["nll"] is None:
                break
            value = r["nll"] + ridge * w @ w
            if value > before + 1e-9 * abs(before):  # overshot: half the step
                step = step / 2
                w = w + step
                continue
            before, last = value, size
            step, size = _newton_step(r, xs, w, ridge)
            if _flat(size, last, value, tol):
                break
            w = w - step
    finally:
        rows.unpersist()
    return w


def _features(specs: dict[str, list[str]]) -> list[str]:
    return sorted({x for xs in specs.values() for x in xs})


def _fit_terms(rows: DataFrame, xs: list[str], fits: dict[tuple[str, int], np.ndarray], hessian: bool = True) -> DataFrame:
    """spec, cut, nll, g_<x>, h_<x>_<y> as of `pl_terms`, of each fit's weights over the contests before its cut. A contest is sorted once, and one
    task takes it through all fits that see it: rows are not copied, what is summed up is a row a contest and fit."""
    names, at = list(fits), np.array([c for _, c in fits], dtype="int64")
    weights, pairs = np.array([fits[k] for k in names]), [(i, j) for i in range(len(xs)) for j in range(i, len(xs))] if hessian else []
    columns = ["nll", *[f"g_{x}" for x in xs], *[f"h_{xs[i]}_{xs[j]}" for i, j in pairs]]

    def contest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("finish", kind="stable")
        x, seen = pdf[xs].to_numpy(dtype="float64"), np.flatnonzero(at > pdf["race_seq"].iat[0])
        out = np.zeros((len(seen), len(columns)))
        for row, k in zip(out, seen):
            u = x @ weights[k]
            top = u.max()
            e = np.exp(u - top)
            behind = e[::-1].cumsum()[::-1]
            q = e * (1 / behind).cumsum()
            row[0] = (np.log(behind) + top - u).sum()
            row[1 : 1 + len(xs)] = (q - 1) @ x
            if hessian:
                mean = (e[:, None] * x)[::-1].cumsum(0)[::-1] / behind[:, None]
                h = x.T @ (q[:, None] * x) - mean.T @ mean
                row[1 + len(xs) :] = [h[i, j] for i, j in pairs]
        found = pd.DataFrame(out, columns=columns)
        return found.assign(fit=seen.astype("int32"))[["fit", *columns]]

    t = rows.select("race_id", "race_seq", "finish", *xs).groupBy("race_id").applyInPandas(contest, ", ".join(["fit int", *[f"`{c}` double" for c in columns]]))
    table = rows.sparkSession.createDataFrame([(k, s, int(c)) for k, (s, c) in enumerate(names)], "fit int, spec string, cut int")
    return t.groupBy("fit").agg(*[F.sum(c).alias(c) for c in columns]).join(F.broadcast(table), "fit").drop("fit")


def walk_forward_fits(rows: DataFrame, specs: dict[str, list[str]], cuts: list[int], ridge: float = 0.5, steps: int = 20, tol: float = 1e-6) -> dict[tuple[str, int], np.ndarray]:
    """M03. {(set, cut): weights over all features in name order, zero outside the set}, each fitted on contests before the cut (race_seq < cut).

    The first Newton step of all fits comes from one pass: at weights zero a contest's gradient and Hessian are the same in every fit, so a cut's are
    prefix sums of a row a contest. From there all fits go on together, one aggregate a step; those that are flat drop out of the next one."""
    xs = _features(specs)
    own = {s: [xs.index(x) for x in of] for s, of in specs.items()}
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]

    def terms(r) -> tuple[np.ndarray, np.ndarray]:
        h = np.zeros((len(xs), len(xs)))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h_{xs[i]}_{xs[j]}"]
        return np.array([r[f"g_{x}"] for x in xs]), h

    def newton(spec: str, g: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
        at, full = own[spec], np.zeros(len(xs))
        g = (g + 2 * ridge * w)[at]
        full[at] = np.linalg.solve(h[np.ix_(at, at)] + 2 * ridge * np.eye(len(at)), g)
        return full, float(np.abs(g).max(initial=0.0))

    first = sorted(pl_terms(rows, xs, F.lit(0.0), ["race_seq"], True).collect(), key=lambda r: r["race_seq"])  # a row a contest
    seqs, sums = [r["race_seq"] for r in first], [terms(r) for r in first]
    g0 = np.cumsum([np.zeros(len(xs)), *[g for g, _ in sums]], axis=0)
    h0 = np.cumsum([np.zeros((len(xs), len(xs))), *[h for _, h in sums]], axis=0)
    weights, last, value, sizes = {}, {}, {}, {}
    for s in specs:
        for c in sorted(set(cuts)):
            k = int(np.searchsorted(seqs, c))
            last[s, c], _ = newton(s, g0[k], h0[k], np.zeros(len(xs)))
            weights[s, c] = -last[s, c]
    left = {k for k in weights if k[1] > seqs[0]} if seqs else set()
    for _ in range(steps):
        if not left:
            break
        for r in _fit_terms(rows, xs, {k: weights[k] for k in left}).collect():  # a row a fit
            k = r["spec"], r["cut"]
            now = r["nll"] + ridge * weights[k] @ weights[k]
            if now > value.get(k, np.inf) + 1e-9 * abs(now):  # overshot: half the step
                last[k] = last[k] / 2
                weights[k] = weights[k] + last[k]
                continue
            value[k] = now
            past = sizes.get(k, np.inf)
            last[k], sizes[k] = newton(k[0], *terms(r), weights[k])
            if _flat(sizes[k], past, now, tol):
                left.discard(k)
            else:
                weights[k] = weights[k] - last[k]
    return weights


def _sets(specs: dict[str, list[str]] | list[str]) -> dict[str, list[str]]:
    """The named feature sets; a plain list is one set named "all"."""
    return specs if isinstance(specs, dict) else {"all": list(specs)}


def _walk(rows: DataFrame, specs: dict[str, list[str]], least: int, every: int) -> tuple[DataFrame, dict[int, int]]:
    """Entrants that have every feature of every set, so that all sets see identical contests, and {contest scored: its cut}."""
    xs = _features(specs)
    rows = materialize(rows.select("race_id", "race_seq", "driver_id", "finish", *xs).dropna(subset=xs), "walk")
    scored = [r["race_seq"] for r in rows.select("race_seq").distinct().orderBy("race_seq").collect()][least:]  # a row a contest
    return rows, {s: scored[k - k % every] for k, s in enumerate(scored)}


def pl_walk_forward(rows: DataFrame, specs: dict[str, list[str]] | list[str], ridge: float = 0.5, least: int = 20, every: int = 1) -> DataFrame:
    """M03. spec, race_id, race_seq, driver_id, finish, u of every contest after `least` others, by weights fitted on earlier contests alone,
    for several feature sets on identical contests (a plain list of features is one set). every: contests between refits. No contest scored: no rows."""
    specs = _sets(specs)
    rows, cut = _walk(rows, specs, least, every)
    fits, spark = walk_forward_fits(rows, specs, list(cut.values()), ridge), rows.sparkSession
    at = [(s, int(q), [float(x) for x in fits[s, c]]) for q, c in cut.items() for s in specs]
    out = rows.join(F.broadcast(spark.createDataFrame(at, "spec string, race_seq int, w array<double>")), "race_seq")
    u = sum((F.col("w")[k] * F.col(x) for k, x in enumerate(_features(specs))), F.lit(0.0))
    return out.select("spec", "race_id", "race_seq", "driver_id", "finish", u.alias("u"))


def walk_forward_gradient(rows: DataFrame, specs: dict[str, list[str]] | list[str], ridge: float = 0.5, least: int = 20, every: int = 1) -> DataFrame:
    """spec, cut, gradient: the largest absolute entry of the penalised gradient at each fit of M03, over the set's features."""
    specs = _sets(specs)
    rows, cut = _walk(rows, specs, least, every)
    fits, xs = walk_forward_fits(rows, specs, list(cut.values()), ridge), _features(specs)
    if not fits:
        return rows.sparkSession.createDataFrame([], "spec string, cut int, gradient double")
    t, spark = _fit_terms(rows, xs, fits, False), rows.sparkSession
    w = spark.createDataFrame([(s, int(c), [float(k) for k in x]) for (s, c), x in fits.items()], "spec string, cut int, w array<double>")
    g = [F.when(F.col("spec").isin([s for s, of in specs.items() if x in of]), F.abs(F.col(f"g_{x}") + 2 * ridge * F.col("w")[k])).otherwise(0.0) for k, x in enumerate(xs)]
    return t.join(F.broadcast(w), ["spec", "cut"]).select("spec", "cut", F.array_max(F.array(*g)).alias("gradient"))


def predicted_rank(rows: DataFrame) -> DataFrame:
    """M04, last part; also M05's expected rank: by utility, ties by entrant."""
    return rows.withColumn("predicted", F.row_number().over(W.partitionBy("race_id").orderBy(F.desc("u"), "driver_id")))


def rank_residual(rows: DataFrame) -> DataFrame:
    """M05. Finish less the rank expected by utility."""
    return predicted_rank(rows).withColumn("residual", F.col("finish") - F.col("predicted"))


def spearman_by(rows: DataFrame, a: str, b: str, group: list[str], least: int = 3) -> DataFrame:
    """M06. Rank correlation with average ranks per group; null when a side is constant or rows are too few."""
    t = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"_a": avg_rank(F.col(a), *group), "_b": avg_rank(F.col(b), *group)})
    return t.groupBy(*group).agg(F.when(F.count("*") >= least, pearson(F.col("_a"), F.col("_b"))).alias("rho"), F.count("*").alias("n"))


def kendall_by(rows: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """M07. tau-b per group of two rows or more and the pairwise accuracy (tau + 1) / 2, from counted inversions and ties: no pair is formed.
    A pair with a null counts for the side that has both values."""
    t = materialize(rows.select(*group, F.col(a).alias("_x"), F.col(b).alias("_y")), "scores")
    s = t.groupBy(*group).agg(F.count("*").alias("_rows")).filter("_rows > 1").join(pair_counts(t, "_x", "_y", group), group, "left")
    for of, columns, name in ((t.filter("_x is not null"), [], "ax"), (t, ["_x"], "tx"), (t.filter("_y is not null"), [], "ay"), (t, ["_y"], "ty")):
        s = s.join(tied_pairs(of, columns, group, name), group, "left").fillna(0, [name])
    s = s.withColumns({"s": F.col("concordant") - F.col("discordant"), "na": F.col("ax") - F.col("tx"), "nb": F.col("ay") - F.col("ty")})
    tau = safe_div(F.col("s"), F.sqrt(F.col("na").cast("double") * F.col("nb")))
    return s.select(*group, tau.alias("tau"), ((tau + 1) / 2).alias("accuracy"))


def wilcoxon(rows: DataFrame, d: Column) -> DataFrame:
    """M09. One row: n of non-zero differences, W+, W-, z with the tie term, and the one-sided p of W+ (exact under 50 pairs)."""
    t = ranked(rows.select(d.cast("double").alias("d")).filter("d <> 0").withColumn("_a", F.abs("d")), "_a", [], name="r")
    ties = t.groupBy(F.abs("d").alias("x")).agg(F.count("*").alias("c")).agg(F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    s = t.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"))
    n = F.col("n").cast("double")  # its cube leaves the longs at some million rows
    var = n * (n + 1) * (2 * n + 1) / 24 - F.coalesce("ties", F.lit(0.0)) / 48
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.nullif(F.sqrt(var), F.lit(0.0))
    p = F.udf(lambda w, n: signed_rank_sf(w, n) if n else 1.0, "double")  # one row
    return s.join(ties).select("n", "w_plus", "w_minus", z.alias("z"), p("w_plus", "n").alias("p"))


def paired_gate(rows: DataFrame, d: Column, most: float = 0.0167, least: float = 0.005) -> DataFrame:
    """Z06. One row: n, z and one-sided p of the signed ranks of the differences, their mean, whether it reaches `least` (lifts), and the verdict:
    adopt when p is `most` or less and the mean lifts, else keep. Without differences: keep."""
    t = wilcoxon(rows, d).join(rows.agg(F.avg(d).alias("mean_d")))  # two single rows
    lifts = F.coalesce(F.col("mean_d") >= least, F.lit(False))
    return t.select("n", "z", "p", "mean_d", lifts.alias("lifts"), F.when(lifts & (F.col("p") <= most), "adopt").otherwise("keep").alias("verdict"))


def bootstrap_mean_ci(rows: DataFrame, value: str, key: str, group: str, reps: int = 4000, level: float = 0.95, seed: int = 1) -> DataFrame:
    """M10. Percentile interval of the mean per group. Row number floor(u * n) of each draw, u from md5(group, replicate, draw, seed).
    A group's values (contests, not entrants) are one array, which each replicate draws from in place: nothing is joined."""
    t = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))).alias("_t"), F.avg(value).alias("mean"), F.count("*").alias("n"))
    at = F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda d: F.floor(uniform(F.col(group), F.col("rep"), d, F.lit(seed)) * F.col("n")).cast("int"))
    drawn = t.repartition(group).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_v", F.filter(F.transform(at, lambda i: F.get("_t", i)["v"]), lambda x: x.isNotNull()))
    means = drawn.select(group, "mean", "n", (F.aggregate("_v", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("_v"), F.lit(0))).alias("m"))
    tail = (1 - level) / 2
    q = means.groupBy(group).agg(F.first("mean").alias("mean"), F.first("n").alias("n"), F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return q.select(group, "mean", "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def two_sample(rows: DataFrame, value: str, flag: str) -> DataFrame:
    """M11. One row: one-sample t of the flagged rows with its p, Mann-Whitney U of flagged against others, and z of U."""
    t = ranked(rows.filter(F.col(value).isNotNull()), value, [], name="r")
    on = F.col(flag)
    x = F.when(on, F.col(value).cast("double"))
    s = t.agg(F.count(x).alias("n1"), F.count_if(~on).alias("n2"), F.sum(F.when(on, F.col("r"))).alias("r1"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    tt = safe_div(F.col("mean"), F.col("sd") / F.sqrt("n1"))
    a, b = F.col("n1").cast("double"), F.col("n2").cast("double")  # their products leave the longs at some million rows
    u = F.col("r1") - a * (a + 1) / 2
    z = safe_div(u - a * b / 2, F.sqrt(a * b * (a + b + 1) / 12))
    p = F.udf(lambda t, n: None if t is None else 2 * student_sf(abs(t), n - 1), "double")  # one row
    return s.select("n1", "n2", tt.alias("t"), p(tt, "n1").alias("p"), u.alias("u"), z.alias("z"))


def variance_shares(lambdas: DataFrame, worths: DataFrame, armed: float = 0.20, watched: str = "team_name") -> DataFrame:
    """M16. factor, lam, sd = sqrt(1 / (2 lam)), its share of the summed variances, sd_empirical (deviation of the factor's worths, divisor
    n), n entities, trigger (the watched factor's share is `armed` or more; null for other factors). worths: factor, entity, worth."""
    v = 1 / (2 * F.col("lam"))
    t = lambdas.select("factor", "lam", F.sqrt(v).alias("sd"), (v / F.sum(v).over(W.partitionBy())).alias("share"))  # a row a factor
    own = worths.groupBy("factor").agg(F.stddev_pop("worth").alias("sd_empirical"), F.count("*").alias("n"))
    return t.join(own, "factor", "left").withColumn("trigger", F.when(F.col("factor") == watched, F.col("share") >= armed))


def ahead_edges(runs: DataFrame, entity: str) -> DataFrame:
    """M17, edges: entity finished ahead of the next finisher; longer chains follow from these."""
    nxt = F.lead(entity).over(W.partitionBy("race_id").orderBy("finish"))
    return runs.select(F.col(entity).cast("string").alias("a"), nxt.cast("string").alias("b")).filter("b is not null and a <> b").distinct()


def _skips(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ends, skips) of the nodes with one edge out: where their chain of such nodes ends (node, to), and edges (a, b) that skip 1, 2, 4 ..
    nodes ahead, so that a chain is passed in about the logarithm of its length. Chains that close in a ring have no end; they are followed
    once around."""
    lone = edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("to")).filter("n = 1").select(F.col("a").alias("node"), "to")
    now, skips, most = materialize(lone, "chains"), None, max(1, edges.count())
    for _ in range(most.bit_length() + 1):
        skips = now if skips is None else skips.unionByName(now)
        on = now.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        longer = materialize(now.join(on, "to", "left").select("node", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved")), "chains")
        now = longer.select("node", "to")
        if longer.filter("moved").isEmpty():
            break
    return now, skips.select(F.col("node").alias("a"), F.col("to").alias("b")).filter("a <> b").distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges without those at nodes that nothing leads to, or only a chain from such a node: these are on no ring."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    ends, _ = _skips(back)
    heads = edges.select(F.col("a").alias("node")).distinct().join(edges.select(F.col("b").alias("node")).distinct(), "node", "left_anti")
    gone = materialize(heads.unionByName(ends.join(heads.withColumnRenamed("node", "to"), "to", "left_semi").select("node")), "trimmed")
    return edges.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _colours(edges: DataFrame) -> DataFrame:
    """node, colour: the least node that reaches it, itself included. What reaches my colour reaches me: so each round a node takes the
    least colour of the nodes before it, and then the colour of its colour."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    colour = materialize(ends.select("node", F.col("node").alias("colour")), "colours")
    while True:
        before = edges.join(colour, edges["a"] == F.col("node")).groupBy("b").agg(F.min("colour").alias("c"))
        step = colour.join(before, colour["node"] == before["b"], "left").select("node", F.col("colour").alias("old"), F.least("colour", F.coalesce("c", "colour")).alias("colour"))
        of = step.select(F.col("node").alias("at"), F.col("colour").alias("up"))
        colour = materialize(step.join(of, F.col("colour") == F.col("at")).select("node", "old", F.least("colour", "up").alias("colour")), "colours")
        if colour.filter("colour <> old").isEmpty():
            return colour.select("node", "colour")
        colour = colour.select("node", "colour")


def strong_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """M17. node, component (its smallest node): nodes that reach each other. Edges (a, b); loops and repeated edges change nothing.

    Nodes on no ring are trimmed from both sides, whole chains at once. Each node left takes the least node that reaches it as colour, in an
    order by hash, so that few colours end early; inside a colour the nodes that reach the colour's own node are a component. Both searches
    also use edges that skip ahead over chains, so a long path takes rounds in the logarithm of its length."""
    nodes = materialize(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct(), "nodes")
    mixed = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), F.col(c))
    kind = edges.schema["a"].dataType.simpleString()
    texts = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).filter("a <> b")
    now, found = materialize(texts.select(mixed("a").alias("a"), mixed("b").alias("b")).distinct(), "edges"), None
    for _ in range(rounds):
        while True:
            size = now.count()
            now = materialize(_reversed(_trimmed(_reversed(materialize(_trimmed(now), "edges")))), "edges")
            if now.count() > 0.9 * size or now.isEmpty():
                break
        if now.isEmpty():
            break
        fast = materialize(now.unionByName(_skips(now)[1]).unionByName(_reversed(_skips(_reversed(now))[1])).distinct(), "edges")
        colour = _colours(fast)
        of = lambda side: colour.select(F.col("node").alias(side), F.col("colour").alias(f"c{side}"))
        inside = materialize(fast.join(of("a"), "a").join(of("b"), "b").filter("ca = cb").select("a", "b"), "inside")
        reached = front = materialize(colour.filter("node = colour").select("node", F.col("colour").alias("c")), "back")
        while True:  # the nodes found last are reached from those before them
            more = inside.join(front.select(F.col("node").alias("b"), "c"), "b").select(F.col("a").alias("node"), "c").distinct()
            front = materialize(more.join(reached.select("node"), "node", "left_anti"), "back")
            if front.isEmpty():
                break
            reached = materialize(reached.unionByName(front), "back")
        found = reached if found is None else found.unionByName(reached)
        gone = reached.select("node")
        now = materialize(now.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"), "edges")
    else:
        raise RuntimeError(f"components left after {rounds} rounds")
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    plain = found.select(F.substring("node", 17, 1 << 30).cast(kind).alias("node"), "c")
    named = materialize(plain.join(plain.groupBy("c").agg(F.min("node").alias("component")), "c").select("node", "component"), "components")
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def connectivity(runs: DataFrame, factors: list[str], window: str) -> DataFrame:
    """M17, report. window ('pooled' or a value of `window`), factor, n_entities, n_components, connected (one component), outside (the entities
    outside the largest component, sorted and joined by commas; of equally large ones that with the smallest entity; null if none).
    An entity whose contests have no other is a component of its own."""
    cell = F.array(F.lit("pooled"), F.col(window).cast("string"))
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("e")) for f in factors])).alias("x")
    t = runs.select("race_id", "finish", *factors, F.explode(cell).alias("_w")).select("race_id", "finish", "_w", long)
    t = materialize(t.select("race_id", "finish", "_w", "x.f", "x.e").filter("e is not null"), "standings")
    name = F.to_json(F.struct("_w", "f", "e"))
    nxt = F.lead(name).over(W.partitionBy("race_id", "_w", "f").orderBy("finish"))
    edges = t.select(name.alias("a"), nxt.alias("b")).filter("b is not null and a <> b").distinct()
    every = t.select("_w", "f", "e", name.alias("node")).distinct()
    of = every.join(strong_components(edges), "node", "left").select("_w", "f", "e", F.coalesce("component", "node").alias("c"))
    of = materialize(of, "connectivity")
    sizes = of.groupBy("_w", "f", "c").agg(F.count("*").alias("n"), F.min("e").alias("first"))
    heads = sizes.groupBy("_w", "f").agg(F.sum("n").alias("n_entities"), F.count("*").alias("n_components"), F.min(F.struct(-F.col("n"), "first", "c")).alias("g"))
    heads = heads.select("_w", "f", "n_entities", "n_components", F.col("g.c").alias("g"))
    rest = of.join(heads.select("_w", "f", "g"), ["_w", "f"]).filter("c <> g").groupBy("_w", "f").agg(F.array_join(F.sort_array(F.collect_list("e")), ",").alias("outside"))  # the report's own list
    done = heads.join(rest, ["_w", "f"], "left")
    return done.select(F.col("_w").alias("window"), F.col("f").alias("factor"), "n_entities", "n_components", (F.col("n_components") == 1).alias("connected"), "outside")


def weighted_pearson(x: Column, y: Column, w: Column) -> Column:
    """M18. Weighted correlation as an aggregate; null at zero variance."""
    sw = F.sum(w)
    mx, my = F.sum(w * x) / sw, F.sum(w * y) / sw
    vx, vy = F.sum(w * x * x) / sw - mx * mx, F.sum(w * y * y) / sw - my * my
    return F.when((vx > 1e-12) & (vy > 1e-12), (F.sum(w * x * y) / sw - mx * my) / F.sqrt(F.greatest(vx, F.lit(1e-300)) * F.greatest(vy, F.lit(1e-300))))


def venue_pair_similarity(residuals: DataFrame, least: int = 3) -> DataFrame:
    """M19. Per venue pair (a < b): mean over left-out seasons of the weighted correlation of the common entrants' mean residuals,
    weight the smaller count; also the folds' deviation and number, common entrants and weight over all seasons."""
    cell = materialize(residuals.groupBy("venue", "driver_id", "year").agg(F.sum("residual").cast("double").alias("s"), F.count("*").alias("n")), "cells")
    total = cell.groupBy("venue", "driver_id").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    years = cell.select("year").distinct()
    left = total.join(F.broadcast(years)).join(cell, ["venue", "driver_id", "year"], "left")
    n, s = F.col("tn") - F.coalesce("n", F.lit(0)), F.col("ts") - F.coalesce("s", F.lit(0.0))
    fold = left.withColumns({"m": F.when(n > 0, s / F.nullif(n, F.lit(0))), "k": n}).filter("m is not null").select("venue", "driver_id", "year", "m", "k")
    a = fold.select(F.col("venue").alias("a"), "driver_id", "year", F.col("m").alias("ma"), F.col("k").alias("ka"))
    b = fold.select(F.col("venue").alias("b"), "driver_id", "year", F.col("m").alias("mb"), F.col("k").alias("kb"))
    w = F.least("ka", "kb").cast("double")
    by_fold = a.join(b, ["driver_id", "year"]).filter("a < b").groupBy("a", "b", "year").agg(F.when(F.count("*") >= least, weighted_pearson(F.col("ma"), F.col("mb"), w)).alias("r"))
    whole = total.select(F.col("venue").alias("a"), "driver_id", F.col("tn").alias("na")).join(total.select(F.col("venue").alias("b"), "driver_id", F.col("tn").alias("nb")), "driver_id").filter("a < b")
    size = whole.groupBy("a", "b").agg(F.count("*").alias("overlap"), F.sum(F.least("na", "nb")).alias("weight"))
    pair = by_fold.groupBy("a", "b").agg(F.avg("r").alias("sim"), F.stddev_pop("r").alias("fold_sd"), F.count("r").alias("folds"))
    return pair.join(size, ["a", "b"])


def neighbours(pairs: DataFrame, k: int = 3) -> DataFrame:
    """M21. venue, rank, other, sim and flags: among the top k, in the bottom half; both directions of each pair."""
    both = pairs.select(F.col("a").alias("venue"), F.col("b").alias("other"), "sim").unionByName(pairs.select(F.col("b").alias("venue"), F.col("a").alias("other"), "sim")).filter("sim is not null")
    w = W.partitionBy("venue")
    t = both.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("sim"), "other")), "n": F.count("*").over(w)})
    return t.select("venue", "other", "sim", "rank", (F.col("rank") <= k).alias("top"), (F.col("rank") > F.col("n") / 2).alias("bottom_half"))


def best_partition(pairs: DataFrame, covariates: DataFrame, least: int = 3) -> DataFrame:
    """M24, one level. candidate splits (name, threshold) of the venues of a node with their gain: within-left + within-right - between
    mean similarity, leaves of `least` or more. covariates: venue, name, value. The best has the largest gain."""
    c = materialize(covariates.select("venue", "name", F.col("value").cast("double").alias("value")), "covariates")
    cuts = c.select("name", F.col("value").alias("threshold")).distinct()
    side = c.join(cuts, "name").withColumn("left", F.col("value") <= F.col("threshold"))
    sizes = side.groupBy("name", "threshold").agg(F.count_if("left").alias("n_left"), F.count_if(~F.col("left")).alias("n_right")).filter(F.least("n_left", "n_right") >= least)
    a = side.select("name", "threshold", F.col("venue").alias("a"), F.col("left").alias("la"))
    b = side.select("name", "threshold", F.col("venue").alias("b"), F.col("left").alias("lb"))
    t = pairs.filter("sim is not null").join(a, "a").join(b, ["name", "threshold", "b"])
    mean = lambda cond: F.avg(F.when(cond, F.col("sim")))
    g = t.groupBy("name", "threshold").agg(mean(F.col("la") & F.col("lb")).alias("wl"), mean(~F.col("la") & ~F.col("lb")).alias("wr"), mean(F.col("la") != F.col("lb")).alias("bt"))
    return g.join(sizes, ["name", "threshold"]).select("name", "threshold", "n_left", "n_right", (F.col("wl") + F.col("wr") - F.col("bt")).alias("gain"))


def partition_tree(pairs: DataFrame, covariates: DataFrame, least: int = 3, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """M24. (leaves: venue, leaf; splits: node, depth, name, threshold, gain, n_left, n_right), nodes numbered as in a heap: 1 is the root, 2 k
    the venues of node k at or under its threshold, 2 k + 1 those above. covariates: venue, name, value (a name counts in a node whose
    venues all have it); thresholds are midpoints of neighbouring values.

    All nodes of a level are split by one job: a candidate is a node, a name and a threshold, its gain within-left + within-right - between
    mean similarity; the best of a node (ties by name, then threshold) splits it if its gain is over 0. A node under 2 * least venues is a leaf."""
    c = materialize(covariates.select("venue", "name", F.col("value").cast("double").alias("value")), "covariates")  # read at every level
    at = materialize(c.select("venue").distinct().withColumn("node", F.lit(1).cast("long")), "tree")
    splits = None
    sim = materialize(pairs.filter("sim is not null").select("a", "b", "sim"), "tree-pairs")
    for level in range(depth):
        open_ = at.filter(F.col("node") >= 2**level)
        node = open_.join(open_.groupBy("node").agg(F.count("*").alias("_n")), "node").filter(F.col("_n") >= 2 * least)
        v = node.join(c, "venue").filter("value is not null")
        whole = v.groupBy("node", "name").agg(F.count("*").alias("k"), F.max("_n").alias("m")).filter("k = m").select("node", "name")
        values = v.join(whole, ["node", "name"]).select("node", "name", "value").distinct()
        nxt = F.lead("value").over(W.partitionBy("node", "name").orderBy("value"))
        cuts = values.withColumn("threshold", (F.col("value") + nxt) / 2).filter("threshold is not null").select("node", "name", "threshold")
        side = v.select("venue", "node", "name", "value").join(cuts, ["node", "name"]).select("node", "name", "threshold", "venue", (F.col("value") <= F.col("threshold")).alias("left"))
        sizes = side.groupBy("node", "name", "threshold").agg(F.count_if("left").alias("n_left"), F.count_if(~F.col("left")).alias("n_right")).filter(F.least("n_left", "n_right") >= least)
        one = side.withColumnsRenamed({"venue": "a", "left": "la"})
        two = side.withColumnsRenamed({"venue": "b", "left": "lb"})
        t = sim.join(one, "a").join(two, ["node", "name", "threshold", "b"])
        mean = lambda cond: F.avg(F.when(cond, F.col("sim")))
        g = t.groupBy("node", "name", "threshold").agg((mean(F.col("la") & F.col("lb")) + mean(~F.col("la") & ~F.col("lb")) - mean(F.col("la") != F.col("lb"))).alias("gain"))
        g = g.join(sizes, ["node", "name", "threshold"]).withColumn("gain", F.round("gain", 9)).filter("gain > 0")
        best = g.groupBy("node").agg(F.min(F.struct(-F.col("gain"), "name", "threshold", "gain", "n_left", "n_right")).alias("x")).select("node", F.lit(level).alias("depth"), "x.name", "x.threshold", "x.gain", "x.n_left", "x.n_right")
        best = materialize(best, "tree-splits")
        splits = best if splits is None else splits.unionByName(best)
        moved = at.join(best.select("node", "name", "threshold"), "node", "left").join(c, ["venue", "name"], "left")
        at = materialize(moved.select("venue", F.when(F.col("threshold").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(F.col("value") <= F.col("threshold"), 0).otherwise(1)).cast("long").alias("node")), "tree")
    return at.select("venue", F.col("node").alias("leaf")), splits


def leaf_labels(leaves: DataFrame, labels: DataFrame) -> DataFrame:
    """M25, rows. venue, leaf, size of the leaf, majority (its most frequent label, ties by name), label, agrees (null without a label).
    leaves: venue, leaf; labels: venue, label."""
    t = leaves.join(labels, "venue", "left")
    counts = t.filter("label is not null").groupBy("leaf", "label").agg(F.count("*").alias("c"))
    most = counts.groupBy("leaf").agg(F.min(F.struct(-F.col("c"), "label"))["label"].alias("majority"))
    sizes = t.groupBy("leaf").agg(F.countDistinct("venue").alias("size"))
    return t.join(sizes, "leaf").join(most, "leaf", "left").select("venue", "leaf", "size", "majority", "label", (F.col("label") == F.col("majority")).alias("agrees"))


def leaf_agreement(leaves: DataFrame, leaf: str, label: str) -> DataFrame:
    """M25. One row: share in the majority label of their leaf (ties by name don't change it), and the adjusted Rand index."""
    c = leaves.groupBy(leaf, label).agg(F.count("*").alias("c"))
    two = lambda x: x * (x - 1) / 2
    cells = c.agg(F.sum(two(F.col("c"))).alias("ij"), F.sum("c").alias("n"))
    rows = leaves.groupBy(leaf).agg(F.count("*").alias("r")).agg(F.sum(two(F.col("r"))).alias("i"))
    cols = leaves.groupBy(label).agg(F.count("*").alias("k")).agg(F.sum(two(F.col("k"))).alias("j"))
    pure = c.groupBy(leaf).agg(F.max("c").alias("m")).agg(F.sum("m").alias("m"))
    t = cells.join(rows).join(cols).join(pure)
    expected = F.col("i") * F.col("j") / two(F.col("n"))
    return t.select((F.col("m") / F.col("n")).alias("purity"), safe_div(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected).alias("ari"))


def predictor_bank(rows: DataFrame, bank: dict[str, Column], digits: int = 9) -> DataFrame:
    """M08. race_id, predictor, rho, n: Spearman's correlation of each named predictor with the finish, on the same rows."""
    of = F.array(*[F.struct(F.lit(n).alias("predictor"), F.round(c, digits).cast("double").alias("p")) for n, c in bank.items()])
    long = rows.select("race_id", "finish", F.explode(of).alias("b")).select("race_id", "finish", "b.*")
    return spearman_by(long, "p", "finish", ["race_id", "predictor"])


GRID_ROWS = 250_000  # a value's rows of a task


def config_grid(rows: DataFrame, values: list[str], half_lives: list[int], burns: list[int], least: list[int], field: int = 5) -> DataFrame:
    """M12. value, half_life, burn, least, mean_rho, n: the mean over contests of Spearman's correlation of a recency-weighted prior mean with
    the finish, for every configuration, all over one history: after `burn` contests, of entrants with `least` earlier values, in
    contests of `field` such.

    A row for each value carries the means of all half-lives, and an entrant is ranked by finish once a value and `least`. A contest is over a
    burn-in or not as a whole, so its correlation counts for each such burn-in without being taken again. The tasks are as many as the rows
    ask for: rows are short where they are shuffled and many where they are sorted, so that their bytes would give too few."""
    from .history import hl_means_prior

    rows = materialize(rows.select("race_id", "race_seq", "driver_id", "finish", *[c for c in values if c != "finish"]), "grid-rows")
    size, fewest = rows.count() * len(values), rows.sparkSession.sparkContext.defaultParallelism
    tasks = lambda n: max(fewest, -(-n // GRID_ROWS))
    at = {f"_f{k}": hl for k, hl in enumerate(half_lives)}
    by_value = F.array(*[F.struct(F.lit(k).alias("_v"), F.col(c).cast("double").alias("_x")) for k, c in enumerate(values)])
    t = rows.select("race_id", "race_seq", "driver_id", "finish", F.explode(by_value).alias("_b")).select("race_id", "race_seq", "driver_id", "finish", "_b.*")
    t = t.repartition(tasks(size), "driver_id", "_v")
    t = hl_means_prior(t, F.col("_x"), at, ["driver_id", "_v"], ["race_seq"], "_k")
    t = t.filter((F.col("_k") > 0) & (F.col("race_seq") > min(burns)) & F.col("finish").isNotNull())
    each = F.explode(F.array_compact(F.array(*[F.when(F.col("_k") >= k, F.lit(k)) for k in least])))
    t = t.select("race_id", "race_seq", "_v", "finish", each.alias("least"), *at)
    group = ["race_id", "_v", "least"]
    t = t.repartition(tasks(size * len(least)), *group).withColumn("_b", avg_rank(F.col("finish"), *group))
    means = F.array(*[F.struct(F.lit(hl).alias("half_life"), F.round(f, 9).alias("_f")) for f, hl in at.items()])
    t = t.select(*group, "race_seq", "_b", F.explode(means).alias("_m")).select(*group, "race_seq", "_b", "_m.*")
    group.append("half_life")
    t = t.withColumn("_a", avg_rank(F.col("_f"), *group))
    rho = t.groupBy(*group, "race_seq").agg(pearson(F.col("_a"), F.col("_b")).alias("rho"), F.count("*").alias("n")).filter(F.col("n") >= max(field, 1))
    rho = rho.withColumn("burn", F.explode(F.array_compact(F.array(*[F.when(F.col("race_seq") > b, F.lit(b)) for b in burns]))))
    names = F.element_at(F.array(*map(F.lit, values)), F.col("_v") + 1)
    return rho.groupBy(names.alias("value"), "half_life", "burn", "least").agg(F.avg("rho").alias("mean_rho"), F.count("*").alias("n"))


def by_type_summary(rho: DataFrame, group: str = "ttype", value: str = "rho") -> DataFrame:
    """M13. By type: n, mean, sd, the standard error of the mean, the share of contests above zero, and its mean less that of all."""
    every = F.avg(value).over(W.partitionBy())
    t = rho.withColumn("_all", every)
    g = t.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.avg(F.when(F.col(value) > 0, 1.0).when(F.col(value).isNotNull(), 0.0)).alias("positive"), F.max("_all").alias("_all"))
    return g.select(group, "n", "mean", "sd", (F.col("sd") / F.sqrt("n")).alias("se"), "positive", (F.col("mean") - F.col("_all")).alias("over_all"))


def pair_blend(pairs: DataFrame, families: DataFrame, races: DataFrame | None = None, overlap: int = 5, weight: float = 10, sides: int = 5, k: float = 5) -> DataFrame:
    """M20. a, b, met, value: a pair's similarity drawn to the mean of its two families (venue, family) by weight / (weight + k); that mean
    alone where the pair has too little overlap or weight, a side with under `sides` contests (races: venue, n), or no similarity."""
    fam = lambda side, f: families.select(F.col("venue").alias(side), F.col("family").alias(f))
    met = F.coalesce((F.col("overlap") >= overlap) & (F.col("weight") >= weight) & F.col("sim").isNotNull(), F.lit(False))
    if races is not None:
        n = lambda side: races.select(F.col("venue").alias(side), F.col("n").alias(f"_n{side}"))
        pairs = pairs.join(n("a"), "a", "left").join(n("b"), "b", "left")
        met = met & (F.coalesce(F.least(F.coalesce("_na", F.lit(0)), F.coalesce("_nb", F.lit(0))), F.lit(0)) >= sides)
    s = pairs.join(fam("a", "f1"), "a").join(fam("b", "f2"), "b").withColumns({"fa": F.least("f1", "f2"), "fb": F.greatest("f1", "f2"), "met": met})
    t = s.join(s.groupBy("fa", "fb").agg(F.avg("sim").alias("pool")), ["fa", "fb"])
    value = F.when(F.col("met"), (F.col("weight") * F.col("sim") + k * F.col("pool")) / (F.col("weight") + k)).otherwise(F.col("pool"))
    return t.select("a", "b", "met", value.alias("value"))


def edge_disagreements(near: DataFrame, edges: DataFrame) -> DataFrame:
    """M22. source, target, kind: 1, an edge between venues in the bottom half of each other's measured neighbours; 2, a top neighbour
    without an edge. near: neighbours(); edges: source, target."""
    n, e = near.withColumnsRenamed({"venue": "source", "other": "target"}), edges.select("source", "target")
    one = n.filter("bottom_half").join(e, ["source", "target"], "left_semi").select("source", "target", F.lit(1).alias("kind"))
    return one.unionByName(n.filter("top").join(e, ["source", "target"], "left_anti").select("source", "target", F.lit(2).alias("kind")))


def edge_agreement(near: DataFrame, edges: DataFrame) -> DataFrame:
    """M23. venue, jaccard of its edges' targets and its top neighbours. A venue has few of both."""
    a = edges.groupBy(F.col("source").alias("venue")).agg(F.collect_set("target").alias("a"))
    b = near.filter("top").groupBy("venue").agg(F.collect_set("other").alias("b"))
    return a.join(b, "venue").select("venue", (F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("jaccard"))


def edge_spearman(pairs: DataFrame, edges: DataFrame, score: str = "score") -> DataFrame:
    """M23, over edges. One row: n edges with both a score and a measured similarity, and Spearman's correlation of the two (null under 3).
    pairs: a < b, sim; edges: source, target, score."""
    e = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.col(score).cast("double").alias("_s"))
    t = e.join(pairs.select("a", "b", "sim"), ["a", "b"]).filter("_s is not null and sim is not null")
    t = materialize(t.select("_s", "sim"), "edge-scores")
    t = ranked(ranked(t, "_s", [], name="_x"), "sim", [], name="_y")
    return t.agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, pearson(F.col("_x"), F.col("_y"))).alias("rho"))


def spec_trio(rho: DataFrame, excluded: Column, held_out: Column) -> DataFrame:
    """M26. One row: the mean rho of all contests, of those not excluded, of those held out."""
    on = lambda c: F.avg(F.when(c, F.col("rho")))
    return rho.agg(F.avg("rho").alias("backtest"), on(~excluded).alias("without_excluded"), on(held_out).alias("held_out"))
