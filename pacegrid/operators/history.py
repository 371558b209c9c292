"""Strictly-prior history of entrants and venues, by window functions (rows W01-W23, Z01-Z03).

Nothing here joins a table with its own past: recency weights have a closed form, so one sort per key is enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import pearson, safe_div

BLOCK = 512


def race_seq(df: DataFrame, order: list[str], name: str = "race_seq") -> DataFrame:
    """W01. df with the 1-based ordinal of its contest among the contests of df alone, by `order`. The list of contests is ranked, not the rows."""
    keys = df.select(*order).distinct()
    ranked = keys.withColumn(name, F.row_number().over(W.orderBy(*order)))
    return df.drop(name).join(ranked, order)


def hl_mean_prior(df: DataFrame, value: Column, name: str, by: list[str], order: list[str], half_life: float = 8.0, where: Column | None = None, count: str | None = None) -> DataFrame:
    """W02, W03. df with the recency-weighted mean of `value` over strictly earlier rows of the key; the newest weighs 1, one
    half_life rows before it 1/2. Rows with a null value or not `where` are passed over and don't age the others; they
    still get a mean. Null without history. `count` names a column for the number of rows that went in.

    The weights are 2^(place / half_life), which cancels the newest one's place. Places are taken in blocks of 512 half-lives, so no
    weight leaves the doubles on long keys or at short half-lives; the block before the present one is carried by its sums, and older ones weigh
    under 2^-512 of the total."""
    return _hl_means(df, value, {name: half_life}, by, order, where, count)


def hl_means_prior(df: DataFrame, value: Column, half_lives: dict[str, float], by: list[str], order: list[str], count: str) -> DataFrame:
    """W02 at several half-lives (name to half-life) in one pass over each key, with `count`. Blocks are those of the shortest half-life, so those that
    go together are at most 8 times as long, and what a block passes over weighs under 2^-64 of the total; longer ones take a pass of their own."""
    out, left = df, dict(sorted(half_lives.items(), key=lambda x: x[1]))
    while left:
        shortest = min(left.values())
        some = {n: h for n, h in left.items() if h <= 8 * shortest}
        left = {n: h for n, h in left.items() if n not in some}
        out = _hl_means(out, value, some, by, order, None, None if left else count)
    return out


def _hl_means(df: DataFrame, value: Column, half_lives: dict[str, float], by: list[str], order: list[str], where: Column | None, count: str | None) -> DataFrame:
    ok = value.isNotNull() if where is None else value.isNotNull() & F.coalesce(where, F.lit(False))
    key, past = W.partitionBy(*by).orderBy(*order), (W.unboundedPreceding, -1)
    block = max(1, int(BLOCK * min(half_lives.values())))
    n = F.coalesce(F.sum(F.when(ok, 1).otherwise(0)).over(key.rowsBetween(*past)), F.lit(0))
    t = df.withColumn("_n", n).withColumn("_block", F.floor(F.col("_n") / block).cast("long"))
    weights = {f"_w_{name}": F.when(ok, F.pow(F.lit(2.0), (F.col("_n") % block - block) / F.lit(h))) for name, h in half_lives.items()}
    t = t.withColumns(weights).withColumns({f"_v_{name}": F.col(f"_w_{name}") * value.cast("double") for name in half_lives})
    inside = W.partitionBy(*by, "_block").orderBy(*order).rowsBetween(*past)
    before = W.partitionBy(*by).orderBy("_block").rangeBetween(-1, -1)

    def total(c: str, h: float) -> Column:
        own, carried = F.sum(c).over(inside), F.sum(c).over(before)
        return F.when(own.isNull(), carried).otherwise(own + F.lit(2.0 ** (-block / h)) * F.coalesce(carried, F.lit(0.0)))

    out = t.withColumns({name: total(f"_v_{name}", h) / total(f"_w_{name}", h) for name, h in half_lives.items()})
    if count:
        out = out.withColumn(count, F.col("_n").cast("long"))
    return out.drop("_n", "_block", *weights, *[f"_v_{name}" for name in half_lives])


def typed_shrunk(df: DataFrame, value: Column, overall: str, name: str, by: list[str], kind: str, order: list[str], half_life: float = 8.0, k: float = 3.0, shrink: bool = True) -> DataFrame:
    """W04. The history of the same kind, m rows of it, drawn to the overall mean: (m * kind + k * overall) / (m + k); overall
    when m is 0. Without shrink: the mean of the kind, or the overall one."""
    t = hl_mean_prior(df, value, "_t", [*by, kind], order, half_life, count="_m")
    mixed = (F.col("_m") * F.col("_t") + F.lit(k) * F.col(overall)) / (F.col("_m") + F.lit(k))
    best = F.when(F.col("_m") == 0, F.col(overall)).otherwise(mixed if shrink else F.coalesce("_t", overall))
    return t.withColumn(name, best).drop("_t", "_m")


def wf_features(runs: DataFrame, half_life: float = 8.0, k: float = 3.0) -> DataFrame:
    """W05. race_id, driver_id, n_hist, fin_h, pace_h, typ_h, start (null or 0 becomes 20), has_pace, finish."""
    order = ["race_seq"]
    t = hl_mean_prior(runs, F.col("finish"), "fin_h", ["driver_id"], order, half_life, count="n_hist")
    t = hl_mean_prior(t, F.col("pace"), "pace_h", ["driver_id"], order, half_life)
    t = typed_shrunk(t, F.col("finish"), "fin_h", "typ_h", ["driver_id"], "ttype", order, half_life, k)
    start = F.when(F.col("start").isNull() | (F.col("start") == 0), 20).otherwise(F.col("start")).cast("int")
    return t.select("race_id", "driver_id", "race_seq", "ttype", "n_hist", "fin_h", "pace_h", "typ_h", start.alias("start"), F.col("pace_h").isNotNull().alias("has_pace"), "finish")


def current_form(runs: DataFrame, by: list[str], value: str = "finish", half_life: float = 8.0, name: str = "form") -> DataFrame:
    """W06, W07. The form as of now: every contest of the key counts, the newest weighs 1. Also the number of them."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("race_seq")))
    t = runs.filter(F.col(value).isNotNull()).withColumn("_w", F.pow(F.lit(2.0), -(nth - 1) / F.lit(half_life)))
    return t.groupBy(*by).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(name), F.count("*").alias("n"))


def z_within(value: Column, group: list[str], nan_safe: bool = False, least: int = 3) -> Column:
    """W10. Population z-score inside the group, 1e-9 added to the deviation. nan_safe: nulls give 0, and groups of fewer than `least` values give 0."""
    w = W.partitionBy(*group)
    z = (value - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + F.lit(1e-9))
    return F.when(F.count(value).over(w) < least, 0.0).otherwise(F.coalesce(z, F.lit(0.0))) if nan_safe else z


def composite_z(df: DataFrame, signs: dict[str, int], group: list[str], name: str) -> DataFrame:
    """W09. Mean of within-group z-scores (sample deviation, sign by column); null unless every column is there and each has a positive deviation over 2 rows or more."""
    w, total, fine = W.partitionBy(*group), F.lit(0.0), F.lit(True)
    for c, sign in signs.items():
        v = F.col(c).cast("double")
        sd = F.stddev_samp(v).over(w)
        total = total + F.lit(float(sign)) * (v - F.avg(v).over(w)) / F.nullif(sd, F.lit(0.0))
        fine = fine & v.isNotNull() & (F.count(v).over(w) >= 2) & (sd > 0)
    return df.withColumn(name, F.when(F.coalesce(fine, F.lit(False)), total / len(signs)))


def eligible(features: DataFrame, burn: int = 15, min_hist: int = 5, min_field: int = 20) -> DataFrame:
    """W11. Rows with enough history and a pace, of contests past the burn-in with enough such rows."""
    rows = features.filter((F.col("n_hist") >= min_hist) & F.col("has_pace") & (F.col("race_seq") > burn))
    return rows.withColumn("field", F.count("*").over(W.partitionBy("race_id"))).filter(F.col("field") >= min_field)


Aggregate = Callable[[Column], Column]
#: W14. Aggregates that both the grouped and the as-of profiles take; any function of a column to an aggregate does.
AGGREGATES: dict[str, Aggregate] = {
    "mean": lambda v: F.avg(v),
    "median": lambda v: F.percentile(v, F.lit(0.5)),
    "beta": lambda v: (F.sum(v) + F.lit(2.0)) / (F.count(v) + F.lit(20.0)),
}


def profile_blend(metric: DataFrame, value: str = "value", how: str | Aggregate = "mean", floor: int = 5, k: float = 5.0) -> DataFrame:
    """W12. Per (venue, era_key): own value, blended n/(n+k) with the family's in that era when the floor is met, else the family's alone."""
    agg = AGGREGATES[how] if isinstance(how, str) else how
    rows = metric.filter(F.col(value).isNotNull())
    own = rows.groupBy("venue", "family", "era_key").agg(agg(F.col(value)).alias("own"), F.count("*").alias("n"))
    family = rows.groupBy("family", "era_key").agg(agg(F.col(value)).alias("pool"), F.count("*").alias("n_pool"))
    t = own.join(family, ["family", "era_key"])
    met = F.col("n") >= floor
    blend = (F.col("n") * F.col("own") + F.lit(k) * F.col("pool")) / (F.col("n") + F.lit(k))
    return t.select("venue", "family", "era_key", "n", "n_pool", "own", "pool", F.when(met, blend).otherwise(F.col("pool")).alias("value"), (~met).alias("backstop"))


def profile_asof(metric: DataFrame, value: str = "value", how: str | Aggregate = "mean", floor: int = 5, k: float = 5.0) -> DataFrame:
    """W13. The same at each contest, from earlier contests of the venue and of the family alone."""
    agg = AGGREGATES[how] if isinstance(how, str) else how
    mine = W.partitionBy("family", "era_key", "venue").orderBy("race_seq").rowsBetween(W.unboundedPreceding, -1)
    pool = W.partitionBy("family", "era_key").orderBy("race_seq").rangeBetween(W.unboundedPreceding, -1)
    v = F.col(value)
    t = metric.withColumns({"n": F.count(v).over(mine), "own": agg(v).over(mine), "pool": agg(v).over(pool)})
    met = F.col("n") >= floor
    blend = (F.col("n") * F.col("own") + F.lit(k) * F.col("pool")) / (F.col("n") + F.lit(k))
    return t.select("race_id", "venue", "family", "era_key", "n", F.when(met, blend).otherwise(F.col("pool")).alias("value"), (~met).alias("backstop"))


def season_frame(standings: DataFrame, cut: int, last_wide: int = 5, last_narrow: int = 3) -> DataFrame:
    """W16. Contest number in the season, standing before the contest, its distance to the cut-line, flags of the season's last contests."""
    season = W.partitionBy("year")
    t = standings.withColumn("race_no", F.dense_rank().over(season.orderBy("race_seq")))
    t = t.withColumn("n_races", F.max("race_no").over(season))
    prior = F.lag("standing").over(W.partitionBy("year", "driver_id").orderBy("race_seq"))
    left = F.col("n_races") - F.col("race_no")
    return t.withColumn("prior_standing", prior).withColumns(
        {"to_cut": F.col("prior_standing") - F.lit(cut), "in_last_wide": left < last_wide, "in_last_narrow": left < last_narrow}
    )


def standings(runs: DataFrame) -> DataFrame:
    """Season standings after each contest: rank by the sum of finishes so far, then by entrant."""
    so_far = W.partitionBy("year", "driver_id").orderBy("race_seq").rowsBetween(W.unboundedPreceding, 0)
    t = runs.withColumn("points", F.sum(F.greatest(F.lit(0), 40 - F.col("finish"))).over(so_far))
    return t.withColumn("standing", F.row_number().over(W.partitionBy("race_id").orderBy(F.desc("points"), "driver_id")))


def pairwise_win_share_prior(runs: DataFrame, excluded: Column, least: int = 5) -> DataFrame:
    """W22. Share of head-to-head meetings won in earlier contests that aren't excluded; 0.5 under `least` contests; ties count for neither.

    In a contest, an entrant beats those ranked behind it and loses to those ahead: two counts from the finish order, then
    prefix sums; no pair is formed."""
    race = W.partitionBy("race_id")
    behind = F.count("*").over(race) - F.count("*").over(race.orderBy("finish").rangeBetween(W.unboundedPreceding, 0))
    ahead = F.coalesce(F.count("*").over(race.orderBy("finish").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = ~excluded
    past = W.partitionBy("driver_id").orderBy("race_seq").rowsBetween(W.unboundedPreceding, -1)
    t = runs.withColumns({"_won": F.when(counts, behind).otherwise(0), "_met": F.when(counts, behind + ahead).otherwise(0), "_on": F.when(counts, 1).otherwise(0)})
    t = t.withColumns({"won": F.coalesce(F.sum("_won").over(past), F.lit(0)), "met": F.coalesce(F.sum("_met").over(past), F.lit(0)), "n_prior": F.coalesce(F.sum("_on").over(past), F.lit(0))})
    share = F.when((F.col("n_prior") < least) | (F.col("met") == 0), 0.5).otherwise(F.col("won") / F.nullif(F.col("met"), F.lit(0)))
    return t.withColumn("win_share", share).drop("_won", "_met", "_on")


def pool_form_excl_self(runs: DataFrame, pool: str, half_life: float = 8.0) -> DataFrame:
    """Z03. Each contest's mean finish of the other members of the entrant's pool, then the prior weighted mean of those over contests."""
    w = W.partitionBy("race_id", pool)
    n = F.count("*").over(w)
    others = F.when(n > 1, (F.sum("finish").over(w) - F.col("finish")) / F.nullif(n - 1, F.lit(0)))
    return hl_mean_prior(runs.withColumn("_others", others.cast("double")), F.col("_others"), "pool_h", ["driver_id"], ["race_seq"], half_life).drop("_others")


def title_contenders(runs: DataFrame, top: int = 4) -> DataFrame:
    """C24. race_id, driver_id of the `top` best placed of each season's last contest, where its field has so many."""
    last = runs.groupBy("year").agg(F.max("race_id").alias("race_id")).select("race_id")
    t = standings(runs).join(last, "race_id", "left_semi").withColumn("field", F.count("*").over(W.partitionBy("race_id")))
    return t.filter((F.col("standing") <= top) & (F.col("field") >= top)).select("race_id", "driver_id")


def local_seq(rows: DataFrame, keys: list[str], order: str = "race_seq") -> DataFrame:
    """W15. rows with `local_seq`: 1, 2, ... within the keys."""
    return rows.withColumn("local_seq", F.row_number().over(W.partitionBy(*keys).orderBy(order)))


def expanding_prior_mean(rows: DataFrame, value: str, keys: list[str], name: str, order: str = "race_seq") -> DataFrame:
    """W17. rows with the plain mean of the value over strictly earlier rows of the keys; null without one."""
    return rows.withColumn(name, F.avg(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)))


def baseline_spike(season: DataFrame, value: str = "finish", late: str = "in_last_wide", cut: int = 16) -> DataFrame:
    """W18. By cohort (in: a standing up to `cut` in the late part of the season; out): n, mean, median and t of each entrant's late mean
    less its mean before."""
    on = F.col(late)
    d = season.groupBy("year", "driver_id").agg(
        (F.avg(F.when(on, F.col(value))) - F.avg(F.when(~on, F.col(value)))).alias("d"),
        F.when(F.max(F.when(on, F.col("prior_standing"))) <= cut, "in").otherwise("out").alias("cohort"),
    )
    t = safe_div(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("*")))
    return d.filter("d is not null").groupBy("cohort").agg(F.count("*").alias("n"), F.avg("d").alias("mean_d"), F.median("d").alias("median_d"), t.alias("t"))


def bucket_rates(season: DataFrame, near: int = 3, running: str = "running", crash: str = "accident") -> DataFrame:
    """W19. By distance to the cut (near, safe, far): n, crash rate, rate of not finishing, and its correlation with the distance."""
    dnf = F.when(F.col("status") != running, 1.0).otherwise(0.0)
    bucket = F.when(F.abs("to_cut") <= near, "near").when(F.col("to_cut") < 0, "safe").otherwise("far")
    return season.filter("to_cut is not null").groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("status") == crash, 1.0).otherwise(0.0)).alias("crash_rate"), F.avg(dnf).alias("dnf_rate"), pearson(F.col("to_cut"), dnf).alias("r")
    )


def season_length(contests: DataFrame, late: Column) -> DataFrame:
    """W20. By year: races, those of the late part, those before."""
    n = F.count_if(late)
    return contests.groupBy("year").agg(F.count("*").alias("races"), n.alias("playoff_races"), (F.count("*") - n).alias("regular_races"))


def latest_board(runs: DataFrame, n: int = 21) -> DataFrame:
    """W21. race_id, driver_id, finish of the first n finishers of the last contest."""
    last = runs.agg(F.max("race_seq").alias("race_seq"))
    return runs.join(last, "race_seq").orderBy("finish").limit(n).select("race_id", "driver_id", "finish")


def pair_prob(a: Column, b: Column) -> Column:
    """W23. Bradley-Terry: a over a + b; one half where both are equal."""
    return F.when(a == b, 0.5).otherwise(safe_div(a, a + b))


def prior_pairs(shares: DataFrame) -> DataFrame:
    """W23. race_id, a, b (a before b by id), p for neighbours in the finishing order."""
    nxt = W.partitionBy("race_id").orderBy("finish")
    t = shares.select("race_id", "driver_id", "win_share", F.lead("driver_id").over(nxt).alias("d2"), F.lead("win_share").over(nxt).alias("s2")).filter("d2 is not null")
    first = F.col("driver_id") < F.col("d2")
    a, b = F.when(first, F.col("win_share")).otherwise(F.col("s2")), F.when(first, F.col("s2")).otherwise(F.col("win_share"))
    return t.select("race_id", F.least("driver_id", "d2").alias("a"), F.greatest("driver_id", "d2").alias("b"), pair_prob(a, b).alias("p"))
