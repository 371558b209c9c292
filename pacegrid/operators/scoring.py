"""Forecast scoring and staged decisions (rows D01-D13), calibration (rows K01-K10)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.inversions import pair_counts
from ..functions.ranks import ranked
from ..sources.shared import materialize
from ..functions.stats import rounded, safe_div, student_sf, uniform
from .pair_blocks import pairs


def canonical_hash(payload: str | None, reset: str = "quotes") -> str | None:
    """SHA-256 of a JSON object with sorted keys, its `reset` block emptied and its seal left out."""
    try:
        d = json.loads(payload)
    except (TypeError, ValueError):
        return None
    if not isinstance(d, dict):
        return None
    d.pop("sha256", None)
    if reset in d:
        d[reset] = []
    return hashlib.sha256(json.dumps(d, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def verify_seal(df: DataFrame, payload: str = "payload", seal: str = "sha256", reset: str = "quotes") -> DataFrame:
    """D01. df with `verified`: the payload's hash, its reset block emptied, is the stored seal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_h=[canonical_hash(x, reset) for x in b[payload]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _h string"
    return df.mapInPandas(run, schema).withColumn("verified", F.coalesce(F.col("_h") == F.col(seal), F.lit(False))).drop("_h")


def common_set(predicted: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """D02. keys with side: both, predicted or results."""
    p, r = predicted.select(*keys).distinct().withColumn("_p", F.lit(True)), results.select(*keys).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_p") & F.col("_r"), "both").when(F.col("_p"), "predicted").otherwise("results")
    return p.join(r, keys, "full_outer").select(*keys, side.alias("side"))


def h2h_accuracy(pairs: DataFrame, group: list[str], least: int = 3, eps: float = 1e-12) -> DataFrame:
    """D03. pairs: p of a ahead of b, finish_a, finish_b. Share of graded pairs whose favourite was ahead; ties, p of one half and missing p are counted apart."""
    tie, even, none = F.col("finish_a") == F.col("finish_b"), F.abs(F.col("p") - 0.5) < eps, F.col("p").isNull()
    graded = ~F.coalesce(tie, F.lit(False)) & ~none & ~F.coalesce(even, F.lit(True))
    right = (F.col("p") > 0.5) == (F.col("finish_a") < F.col("finish_b"))
    g = pairs.groupBy(*group).agg(F.count_if(graded).alias("n"), F.count_if(graded & right).alias("right"), F.count_if(tie).alias("ties"), F.count_if(none).alias("missing"), F.count_if(~none & ~F.coalesce(tie, F.lit(False)) & even).alias("even"))
    return g.withColumn("accuracy", F.when(F.col("n") >= least, F.col("right") / F.nullif(F.col("n"), F.lit(0))))


def score_accuracy(field: DataFrame, group: list[str], u: str = "u", finish: str = "finish", least: int = 3) -> DataFrame:
    """D03 for all pairs of a contest whose chances follow from one utility: n graded pairs, right, ties of finish, even utilities (finish not
    tied), accuracy (null under `least` graded). Counted from inversions and ties; no pair is formed. Entrants without a utility or finish are left out."""
    t = materialize(field.select(*group, F.col(u).cast("double").alias("_x"), F.col(finish).cast("double").alias("_y")), "field")
    c = pair_counts(t, "_x", "_y", group).filter("pairs > 0")
    n = F.col("concordant") + F.col("discordant")
    right = F.col("discordant")  # the higher utility has the lower finish
    return c.select(*group, n.alias("n"), right.alias("right"), F.col("tied_b").alias("ties"), (F.col("tied_a") - F.col("tied_both")).alias("even"), F.when(n >= least, right / F.nullif(n, F.lit(0))).alias("accuracy"))


def clean_quotes(entries: DataFrame) -> DataFrame:
    """D04. entries: race_id, pos, a, b, price_a, price_b (text), closing, ts, void. With `state`: malformed (a price that is no whole number or zero), deduped
    (another of the same unordered pair is better: closing, then time, then file order), void, or kept."""
    pa, pb = F.expr("try_cast(price_a as int)"), F.expr("try_cast(price_b as int)")
    bad = pa.isNull() | pb.isNull() | (pa == 0) | (pb == 0)
    t = entries.withColumns({"pa": pa, "pb": pb, "bad": bad, "lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    w = W.partitionBy("race_id", "lo", "hi", "bad").orderBy(F.desc("closing"), F.desc_nulls_last("ts"), F.desc("pos"))
    t = t.withColumn("nth", F.row_number().over(w))
    state = F.when(F.col("bad"), "malformed").when(F.col("nth") > 1, "deduped").when(F.col("void"), "void").otherwise("kept")
    return t.withColumn("state", state).drop("nth", "bad")


def implied(price: Column) -> Column:
    """Implied probability of an American price."""
    return F.when(price < 0, -price / (100.0 - price)).otherwise(100.0 / F.nullif(price + 100.0, F.lit(0.0)))


def grade_quotes(quotes: DataFrame) -> DataFrame:
    """D05. quotes with p (model, a ahead of b), finishes: strict favourites only. Per contest: n, agree, model_right, book_right, beats, pickem."""
    qa, qb = implied(F.col("pa")), implied(F.col("pb"))
    strict = qa != qb
    book_a, model_a, a_won = qa > qb, F.col("p") > 0.5, F.col("finish_a") < F.col("finish_b")
    g = lambda c: F.count_if(strict & c)
    return quotes.groupBy("race_id").agg(F.count_if(strict).alias("n"), g(book_a == model_a).alias("agree"), g(model_a == a_won).alias("model_right"), g(book_a == a_won).alias("book_right"), g((book_a != model_a) & (model_a == a_won)).alias("beats"), F.count_if(~strict).alias("pickem"))


def score_row(scores: DataFrame, stand_down: str = "SS") -> DataFrame:
    """D06. scores with `notes`: clauses in a fixed order, parted by '; '."""
    notes = F.concat_ws("; ", F.when(F.col("ttype") == stand_down, f"stand-down type {stand_down}"), F.when(F.col("unscored") > 0, F.format_string("%d forecast entrants without result", "unscored")),
                        F.when(F.col("unpredicted") > 0, F.format_string("%d entrants without forecast", "unpredicted")), F.when(F.col("ties") > 0, F.format_string("%d tied pairs", "ties")))
    return scores.withColumn("notes", notes)


def select_unscored(logged: DataFrame, scored: DataFrame) -> DataFrame:
    """D07. The earliest (date, id) logged and not scored."""
    return logged.join(scored.select("race_id"), "race_id", "left_anti").agg(F.min(F.struct("date", "race_id")).alias("m")).select("m.*")


def graded_picks(picks: DataFrame, edge: float = 0.03) -> DataFrame:
    """D08. picks with `reason` (off_book, not_common, tie, no_pick, inadmissible, graded; the first that holds) and `profit` in units of graded ones.
    A pick is the side whose model probability exceeds the implied one by `edge`; a quote first seen at or after the start is inadmissible."""
    ea, eb = F.col("p") - implied(F.col("pa")), (1 - F.col("p")) - implied(F.col("pb"))
    side = F.when((ea >= edge) & (ea >= eb), "a").when(eb >= edge, "b")
    reason = (
        F.when(F.col("pa").isNull() | F.col("pb").isNull(), "off_book").when(F.col("finish_a").isNull() | F.col("finish_b").isNull() | F.col("p").isNull(), "not_common")
        .when(F.col("finish_a") == F.col("finish_b"), "tie").when(side.isNull(), "no_pick").when(F.col("first_seen") >= F.col("start_ts"), "inadmissible").otherwise("graded")
    )
    price = F.when(side == "a", F.col("pa")).otherwise(F.col("pb"))
    won = (side == "a") == (F.col("finish_a") < F.col("finish_b"))
    gain = F.when(price > 0, price / 100.0).otherwise(100.0 / -F.nullif(price, F.lit(0)))
    t = picks.withColumns({"side": side, "reason": reason, "price": price, "won": won})
    return t.withColumn("profit", F.when(F.col("reason") == "graded", F.when(F.col("won"), gain).otherwise(-1.0)))


def resampled(totals: DataFrame, keys: list[str], sums: list[str], reps: int, seed: int = 3, keep: list[str] = []) -> DataFrame:
    """keys, rep and the sums over contests drawn with replacement: contest floor(u * K) of each draw, u from md5(replicate, draw, seed).

    totals: a row a key with `_t`, the array of its contests' totals (structs with the sums as fields) in their order, and K: draws are
    from the first K of them. A replicate is one row that draws from its key's array in place; `keep` are columns carried along."""
    at = F.transform(F.sequence(F.lit(0), (F.col("K") - 1).cast("int")), lambda d: F.floor(uniform(F.col("rep"), d, F.lit(seed)) * F.col("K")).cast("int"))
    t = totals.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_at", at)
    total = lambda c: F.aggregate("_at", F.lit(0.0), lambda s, i: s + F.get("_t", i)[c]).alias(c)
    return t.select(*keys, "rep", *keep, *[total(c) for c in sums])


def contest_arrays(totals: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """keys, _t (an array of a key's contests by race_id, a struct of the sums each), K its length. A key's contests, not its rows."""
    one = F.struct("race_id", *[F.col(c).cast("double").alias(c) for c in sums])
    return totals.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_t")).withColumn("K", F.size("_t").cast("long"))


def _states(arrays: DataFrame, keys: list[str], reps: int, seed: int) -> DataFrame:
    """keys, N, K, total, roi, p_boot, bound, t of the first K contests of each key's array (fields profit, n)."""
    head = F.slice("_t", F.lit(1), F.col("K").cast("int"))
    add = lambda f: F.aggregate(head, F.lit(0.0), lambda s, x: s + f(x))
    mean = F.col("total") / F.col("K")
    spread = F.sqrt(add(lambda x: (x["profit"] - F.col("_mean")) * (x["profit"] - F.col("_mean"))) / F.nullif(F.col("K") - 1, F.lit(0)))
    point = arrays.withColumns({"_picks": add(lambda x: x["n"]).cast("long"), "total": add(lambda x: x["profit"])}).withColumn("_mean", mean)
    point = point.withColumns({"roi": F.col("total") / F.col("_picks"), "t": safe_div(F.col("_mean"), spread / F.sqrt("K"))})
    carried = ["_picks", "K", "total", "roi", "t"]
    rep = resampled(point.repartition(*keys) if keys else point, keys, ["profit", "n"], reps, seed, carried).withColumn("m", F.col("profit") / F.col("n"))
    ordered = F.array_sort(F.collect_list("m"))[int(0.95 * reps)]  # a number a replicate
    return rep.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carried], ((1 + F.count_if(F.col("profit") <= 0)) / (reps + 1)).alias("p_boot"), ordered.alias("bound")).withColumnRenamed("_picks", "N")


def roi_state(picks: DataFrame, keys: list[str], reps: int = 10000, seed: int = 3) -> DataFrame:
    """D09. keys, N, K, total, roi, p_boot (add-one), bound (the order statistic at 95 % of resampled means), t of contest totals."""
    totals = picks.groupBy(*keys, "race_id").agg(F.sum("profit").alias("profit"), F.count("*").alias("n"))
    return _states(contest_arrays(totals, keys, ["profit", "n"]), keys, reps, seed)


def sequential_looks(picks: DataFrame, reps: int = 10000, min_k: int = 20, edge_n: int = 50, null_n: int = 100) -> DataFrame:
    """D10. The state after each contest (look = its place), the look's verdict, and whether it is the first that crosses a boundary.

    Picks are added up by contest once. A look is the contests' array with its own length, so rows are looks x replicates and no pick is copied."""
    totals = picks.groupBy("race_id").agg(F.sum("profit").alias("profit"), F.count("*").alias("n"))
    arrays = contest_arrays(totals, [], ["profit", "n"])
    looks = arrays.select("_t", F.explode(F.sequence(F.lit(1), F.col("K").cast("int"))).alias("look")).filter("size(_t) > 0").withColumn("K", F.col("look").cast("long"))
    s = _states(looks, ["look"], reps, 3)
    p_t = F.udf(lambda t, k: 1.0 if t is None else student_sf(t, k - 1), "double")  # one row a look
    s = s.withColumn("p_t", p_t("t", "K"))
    verdict = F.when(F.col("K") < min_k, None).when((F.col("N") >= edge_n) & (F.col("p_boot") <= 0.001) & (F.col("p_t") <= 0.001), "EDGE").when((F.col("N") >= null_n) & (F.col("bound") < 0), "NO-EDGE")
    s = s.withColumn("verdict", verdict)
    first = F.min(F.when(F.col("verdict").isNotNull(), F.col("look"))).over(W.partitionBy())  # a row a look
    return s.withColumn("standing", F.coalesce(F.col("look") == first, F.lit(False)))


def final_verdict(state: DataFrame, as_of: str, min_k: int = 20, final_n: int = 400, backstop: str = "2028-02-15") -> DataFrame:
    """D11. state with the last look's verdict: none before `final_n` picks or the backstop date."""
    due = (F.col("N") >= final_n) | (F.lit(as_of) >= F.lit(backstop))
    v = F.when(~due, None).when(F.col("K") < min_k, "UNDERPOWERED").when(F.col("p_boot") <= 0.045, "EDGE").when(F.col("N") >= 200, "NO-EDGE").when((F.col("N") >= 100) & (F.col("bound") < 0), "NO-EDGE").otherwise("UNDERPOWERED")
    return state.withColumn("final", v)


def pick_summary(picks: DataFrame, config: str) -> DataFrame:
    """D12. By configuration: n, win rate, mean break-even, profit, roi."""
    even = implied(F.col("price"))
    return picks.groupBy(config).agg(F.count("*").alias("n"), F.avg(F.when(F.col("won"), 1.0).otherwise(0.0)).alias("win_rate"), F.avg(even).alias("break_even"), F.sum("profit").alias("profit"), (F.sum("profit") / F.count("*")).alias("roi"))


def capture_debt(scored: DataFrame, priced: DataFrame, known: DataFrame, as_of: Column, days: int = 45, red: int = 2) -> DataFrame:
    """D13. One row: scored and priced contests among the known ones, their difference, active (a scored one within `days`), red."""
    s, p = scored.join(known, "race_id", "left_semi"), priced.join(known, "race_id", "left_semi").select("race_id").distinct()
    a = s.agg(F.countDistinct("race_id").alias("scored"), F.max("date").alias("last"))
    t = a.join(p.agg(F.count("*").alias("priced")))
    debt, active = F.col("scored") - F.col("priced"), F.datediff(as_of, F.col("last")) <= days
    return t.select("scored", "priced", debt.alias("debt"), active.alias("active"), (active & (debt > red)).alias("red"))


def pair_units(field: DataFrame, floor: float = 0.001, digits: int | None = 6) -> DataFrame:
    """K01, pairs. race_id, id, id2, p_model, p_base, outcome of every pair of a contest, the smaller driver_id first: that it is ahead, by
    utilities and by earlier win shares, rounded to `digits` (bins by p_model then agree between engines) or not. A contest of n entrants has n (n - 1) / 2 units, which the reports below only sum up."""
    from .history import pair_prob

    cut = lambda c: F.greatest(F.lit(floor), F.least(F.lit(1 - floor), c if digits is None else rounded(c, digits)))
    t = pairs(field, ["driver_id", "u", "win_share", "finish"])
    return t.select(
        "race_id", F.col("driver_id1").alias("id"), F.col("driver_id2").alias("id2"), cut(1 / (1 + F.exp(F.col("u2") - F.col("u1")))).alias("p_model"),
        cut(pair_prob(F.col("win_share1"), F.col("win_share2"))).alias("p_base"), F.when(F.col("finish1") < F.col("finish2"), 1).otherwise(0).alias("outcome"),
    )


def entrant_units(probs: DataFrame, p: str, top: int, floor: float = 0.001, digits: int | None = 6) -> DataFrame:
    """K01, win (top = 1) and top-N. The baseline is the same chance for each of the contest's entrants."""
    n = F.count("*").over(W.partitionBy("race_id"))
    cut = lambda c: F.greatest(F.lit(floor), F.least(F.lit(1 - floor), c if digits is None else rounded(c, digits)))
    base = F.least(F.lit(top), n).cast("double") / n
    return probs.select("race_id", F.col("driver_id").alias("id"), F.lit(0).cast("long").alias("id2"), cut(F.col(p)).alias("p_model"), cut(base).alias("p_base"), F.when(F.col("finish") <= top, 1).otherwise(0).alias("outcome"))


def unit_records(markets: dict[str, DataFrame]) -> DataFrame:
    """K01. market, race_id, id, id2, p_model, p_base, outcome of the units of all markets."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [t.select(F.lit(m).alias("market"), "*") for m, t in markets.items()])


# Calibration. units: market, ttype, year, race_id, p_model, p_base, outcome (0 or 1).


SUMS = ["bm", "bb", "lm", "lb"]


def unit_sums(units: DataFrame) -> DataFrame:
    """market, race_id, ttype, year, n and the sums of squared errors (bm, bb) and log losses (lm, lb) of model and baseline. All skills follow from them."""
    m, b, o = F.col("p_model"), F.col("p_base"), F.col("outcome")
    ll = lambda p: -(o * F.log(p) + (1 - o) * F.log(1 - p))
    return units.groupBy("market", "race_id", "ttype", "year").agg(F.sum((m - o) * (m - o)).alias("bm"), F.sum((b - o) * (b - o)).alias("bb"), F.sum(ll(m)).alias("lm"), F.sum(ll(b)).alias("lb"), F.count("*").alias("n"))


def skill_of_sums(sums: DataFrame, keys: list[str], sets: list[list[str]] | None = None) -> DataFrame:
    """K02, K03 from `unit_sums`."""
    grouped = sums.groupingSets(sets, *keys) if sets else sums.groupBy(*keys)
    a = grouped.agg(F.sum("n").alias("n"), *[(F.sum(c) / F.sum("n")).alias(name) for c, name in zip(SUMS, ("b_model", "b_base", "ll_model", "ll_base"))])
    return a.withColumns({"bss": 1 - safe_div(F.col("b_model"), F.col("b_base")), "ll_skill": 1 - safe_div(F.col("ll_model"), F.col("ll_base"))})


def skill(units: DataFrame, keys: list[str], sets: list[list[str]] | None = None) -> DataFrame:
    """K02, K03. Brier and log loss of model and baseline, their skills, n; with `sets` over those grouping sets of the keys."""
    m, b, o = F.col("p_model"), F.col("p_base"), F.col("outcome")
    log_loss = lambda p: -(o * F.log(p) + (1 - o) * F.log(1 - p))
    t = units.withColumns({"_bm": (m - o) * (m - o), "_bb": (b - o) * (b - o), "_lm": log_loss(m), "_lb": log_loss(b)})
    grouped = t.groupingSets(sets, *keys) if sets else t.groupBy(*keys)
    a = grouped.agg(F.avg("_bm").alias("b_model"), F.avg("_bb").alias("b_base"), F.avg("_lm").alias("ll_model"), F.avg("_lb").alias("ll_base"), F.count("*").alias("n"))
    return a.withColumns({"bss": 1 - safe_div(F.col("b_model"), F.col("b_base")), "ll_skill": 1 - safe_div(F.col("ll_model"), F.col("ll_base"))})


def equal_mass_bins(units: DataFrame, keys: list[str], tie: list[str], n_bins: int = 10) -> DataFrame:
    """K04. Bins of near equal counts by p_model: bin i has the places from n*i/n_bins cut to a whole number. Ties by `tie`."""
    t = ranked(units, "p_model", keys, tie, name="_at").withColumns({"_k": F.col("_at") - 1, "_n": F.col("_at_n")})
    i = F.floor((F.col("_k") * n_bins + n_bins - 1) / F.col("_n"))  # the largest i whose first place is not past k
    edge = F.floor(i * F.col("_n") / n_bins)
    t = t.withColumn("bin", F.least(F.when(edge > F.col("_k"), i - 1).otherwise(i), F.lit(n_bins - 1)).cast("int"))
    return t.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("p_model").alias("mean_pred"), F.avg("outcome").alias("obs_freq"))


def murphy(bins: DataFrame, keys: list[str]) -> DataFrame:
    """K05, K06. Reliability, resolution, uncertainty, and the weighted least-squares line of observed on predicted, from bins."""
    w = W.partitionBy(*keys)
    t = bins.withColumn("_n", F.sum("n").over(w)).withColumn("_o", F.sum(F.col("n") * F.col("obs_freq")).over(w) / F.col("_n"))
    n, x, y = F.col("n"), F.col("mean_pred"), F.col("obs_freq")
    g = t.groupBy(*keys).agg(
        (F.sum(n * (x - y) * (x - y)) / F.max("_n")).alias("reliability"), (F.sum(n * (y - F.col("_o")) * (y - F.col("_o"))) / F.max("_n")).alias("resolution"), (F.max("_o") * (1 - F.max("_o"))).alias("uncertainty"),
        F.sum(n).alias("sw"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * x).alias("sxx"), F.sum(n * x * y).alias("sxy"),
    )
    slope = safe_div(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return g.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw")).drop("sw", "sx", "sy", "sxx", "sxy")


def stratum_bundle(units: DataFrame, strata: dict[str, Column], kind: str, tie: list[str], n_bins: int = 10, every: str = "all") -> DataFrame:
    """K10. stratum, market, <kind>, metric, value: K02 to K06 of each stratum and market, of all units (<kind> = `every`) and of each value of
    `kind`. strata: name to condition; they may overlap, and a unit counts in each that it meets. Metrics that are undefined have no row.

    Units are copied once for each stratum and twice for the kind, and written once for both the skills and the bins."""
    keys = ["stratum", "market", kind]
    t = materialize(stratified(units, strata, kind, every).select(*keys, *tie, "p_model", "p_base", "outcome"), "strata")
    return bundle(skill(t, keys), equal_mass_bins(t, keys, tie, n_bins), keys)


def stratified(rows: DataFrame, strata: dict[str, Column], kind: str, every: str = "all") -> DataFrame:
    """rows once for each stratum that they are in, and there for `every` and for their own value of `kind`."""
    at = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in strata.items()]))
    return rows.withColumn("stratum", F.explode(at)).withColumn(kind, F.explode(F.array_compact(F.array(F.lit(every), F.col(kind)))))


def bundle(skills: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """K10 from the skills and the bins by keys: keys, metric, value."""
    both = skills.join(murphy(bins, keys), keys).withColumn("n", F.col("n").cast("double"))
    metrics = [c for c in both.columns if c not in keys]
    return both.unpivot(keys, metrics, "metric", "value").filter("value is not null")


def fixed_bins(units: DataFrame, edges: list[float], keys: list[str], least: int = 100) -> DataFrame:
    """K07. Bins between fixed edges with more than `least` units: n, mean p, observed rate."""
    b = F.lit(0)
    for k, e in enumerate(edges):
        b = F.when(F.col("p_model") >= e, k).otherwise(b)
    return units.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p_model").alias("mean_pred"), F.avg("outcome").alias("obs_freq")).filter(F.col("n") > least)


def fixed_bins_of_counts(counts: DataFrame, edges: list[float], keys: list[str], least: int = 100) -> DataFrame:
    """K07 from counts by chance: keys, p (millionths), n, wins."""
    b = F.lit(0)
    for k, e in enumerate(edges):
        b = F.when(F.col("p") >= round(e * 1e6), k).otherwise(b)
    t = counts.groupBy(*keys, b.alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("p") * F.col("n")).alias("_p"), F.sum("wins").alias("_wins"))
    return t.filter(F.col("n") > least).select(*keys, "bin", "n", (F.col("_p") / F.col("n") / 1e6).alias("mean_pred"), (F.col("_wins") / F.col("n")).alias("obs_freq"))


def cluster_bootstrap_skill(units: DataFrame, keys: list[str], reps: int = 10000, seed: int = 3) -> DataFrame:
    """K08. Brier and log-loss skill with lower and upper order statistics (5 % and 95 %) over resampled contests."""
    return bootstrap_of_sums(_contest_sums(units, keys), keys, reps, seed)


def _contest_sums(units: DataFrame, keys: list[str]) -> DataFrame:
    m, b, o = F.col("p_model"), F.col("p_base"), F.col("outcome")
    ll = lambda p: -(o * F.log(p) + (1 - o) * F.log(1 - p))
    return units.groupBy(*keys, "race_id").agg(F.sum((m - o) * (m - o)).alias("bm"), F.sum((b - o) * (b - o)).alias("bb"), F.sum(ll(m)).alias("lm"), F.sum(ll(b)).alias("lb"), F.count("*").alias("n"))


def bootstrap_of_sums(totals: DataFrame, keys: list[str], reps: int = 10000, seed: int = 3) -> DataFrame:
    """K08 from `unit_sums`, a row a contest and key."""
    w = W.partitionBy(*keys)
    rep = resampled(contest_arrays(totals, keys, ["bm", "bb", "lm", "lb"]), keys, ["bm", "bb", "lm", "lb"], reps, seed).withColumns({"s": 1 - F.col("bm") / F.col("bb"), "l": 1 - F.col("lm") / F.col("lb")})
    at = lambda c, k: F.max(F.when(F.col(f"_{c}") == k + 1, F.col(c)))
    lo, hi = int(0.05 * reps), min(int(0.95 * reps), reps - 1)
    ranked = rep.withColumns({"_s": F.row_number().over(w.orderBy("s", "rep")), "_l": F.row_number().over(w.orderBy("l", "rep"))})
    q = ranked.groupBy(*keys).agg(at("s", lo).alias("lower"), at("s", hi).alias("upper"), at("l", lo).alias("ll_lower"), at("l", hi).alias("ll_upper"))
    point = totals.groupBy(*keys).agg((1 - F.sum("bm") / F.sum("bb")).alias("bss"), (1 - F.sum("lm") / F.sum("lb")).alias("ll_skill"), F.count("*").alias("K"), F.sum("n").alias("N"))
    return point.join(q, keys)


def calibration_verdict(boot: DataFrame, terminal: Column, floor: int = 20, practical: float = 0.01) -> DataFrame:
    """K09. Before the terminal look, and under the floor of contests, always UNDERPOWERED."""
    v = F.when(~terminal | (F.col("K") < floor), "UNDERPOWERED").when((F.col("lower") > 0) & (F.col("bss") >= practical), "CALIBRATED-SKILL").when(F.col("upper") < practical, "NULL").otherwise("UNDERPOWERED")
    return boot.withColumn("verdict", v)
