"""Results that small tables don't show: sums and counts of some million rows, draws and pairs without a row each."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacegrid.functions.draws import hashed_draws
from pacegrid.operators import history, pair_bins, pair_blocks, pricing, rank_model, scoring


def test_fit_is_flat_however_large_its_value(spark):
    """the gradient left over was allowed to grow with the likelihood's value."""
    rng = np.random.default_rng(3)
    rows = []
    for race in range(30):
        x = rng.normal(size=(400, 2))
        order = np.argsort(-(x @ [0.8, -0.4] + rng.gumbel(size=400)))
        rows += [(race, race, d, int(f) + 1, float(x[d, 0]), float(x[d, 1])) for f, d in enumerate(map(int, order))]
    df = spark.createDataFrame(rows, "race_id int, race_seq int, driver_id int, finish int, x0 double, x1 double")
    w = rank_model.pl_fit(df, ["x0", "x1"])
    g = rank_model.pl_terms(df, ["x0", "x1"], rank_model.utility(["x0", "x1"], w), []).first()
    assert abs(g["g_x0"] + w[0]) < 1e-6 and abs(g["g_x1"] + w[1]) < 1e-6
    assert rank_model.walk_forward_gradient(df, {"both": ["x0", "x1"], "one": ["x0"]}, least=28).agg(F.max("gradient")).first()[0] < 1e-6


def test_fits_of_all_cuts_in_one_pass_have_the_window_sums(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(r, r, k + 1, float(a), float(b)) for r in range(6) for k, (a, b) in enumerate(rng.normal(size=(9, 2)))], "race_id int, race_seq int, finish int, a double, b double")
    got = {(r["spec"], r["cut"]): r for r in rank_model._fit_terms(df, ["a", "b"], {("s", 3): np.array([0.3, -0.2]), ("t", 5): np.array([0.0, 1.5])}).collect()}
    for (spec, cut), w in {("s", 3): [0.3, -0.2], ("t", 5): [0.0, 1.5]}.items():
        want = rank_model.pl_terms(df.filter(F.col("race_seq") < cut), ["a", "b"], rank_model.utility(["a", "b"], w), [], True).first()
        for c in ("nll", "g_a", "g_b", "h_a_a", "h_a_b", "h_b_b"):
            assert got[spec, cut][c] == pytest.approx(want[c], rel=1e-10, abs=1e-10)


def test_counts_of_millions_of_rows_multiply(spark):
    """n1 * n2 * (n1 + n2 + 1) left the longs."""
    df = spark.range(5_000_000).select((F.col("id") % 5).cast("int").alias("d"), (F.col("id") % 3 == 0).alias("f"))
    r = rank_model.two_sample(df, "d", "f").first()
    assert (r["n1"], r["n2"]) == (1666667, 3333333) and abs(r["z"]) < 1


@pytest.mark.parametrize("top, expected", [(10, 5), (35, 0)])
def test_first_places_are_those_of_whole_orders(spark, top, expected):
    """Of a large field only scores over a bar are sorted; with (35, 0) many draws have too few and are drawn again."""
    u = np.random.default_rng(5).normal(size=300)
    field = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate(u)] + [(2, k, float(x)) for k, x in enumerate(u[:20])], "race_id int, driver_id long, u double")
    want = {tuple(r) for r in pricing.draw_orders(field, 120).filter(F.col("place") <= top).collect()}
    assert {tuple(r) for r in pricing._top_orders(field, 120, 7, top, expected).collect()} == want
    a, b = (sorted(map(tuple, t.collect())) for t in (pricing.sampled_tops(field, 120, [1, 5, 10]), pricing.topn_prob(pricing.draw_orders(field, 120), 120, [1, 5, 10])))
    assert a == b
    members = field.filter("driver_id % 50 = 7").select("race_id", "driver_id")
    a, b = (sorted(map(tuple, pricing.subset_count_pmf(pricing.draw_orders(field, 120, top=n), members, 120, 3).collect())) for n in (3, None))
    assert a == b


def test_draws_of_a_key_are_the_hashes_one_by_one():
    keys = [b"199504|3|", b"199504|12345|", b"x" * 60]
    want = [[int(hashlib.md5(k + str(d).encode() + b"|7").hexdigest()[:13], 16) for d in range(1010)] for k in keys]
    assert (hashed_draws(keys, 1010, b"|7") == want).all()


def test_pair_sums_without_a_row_a_pair(spark):
    """What is summed up over blocks is what the units add up to."""
    rng = np.random.default_rng(6)
    rows = [(r, "ab"[r % 2], 2000 + r, d, float(np.round(rng.normal(), 1 if r == 1 else 9)), float(rng.integers(0, 3) / 2), int(f) + 1) for r in (1, 2, 3) for d, f in enumerate(rng.permutation(23))]
    field = spark.createDataFrame(rows, "race_id int, ttype string, year int, driver_id long, u double, win_share double, finish int")
    units = scoring.unit_records({"pair": scoring.pair_units(field)}).join(field.select("race_id", "ttype", "year").distinct(), "race_id")
    race = ["race_id", "ttype", "year"]
    got = {r["race_id"]: r for r in pair_blocks.pair_totals(field, race, piece=7).collect()}
    for want in scoring.unit_sums(units).collect():
        assert got[want["race_id"]]["n"] == want["n"] == 253
        for c in ("bm", "bb", "lm", "lb"):
            assert got[want["race_id"]][c] == pytest.approx(want[c], rel=1e-12)
    counts = pair_blocks.pair_counts_by_chance(field, race, ["ttype"], piece=7)
    a = {(r["ttype"], r["bin"]): r for r in scoring.fixed_bins_of_counts(counts, [0.0, 0.3, 0.5], ["ttype"], 5).collect()}
    b = {(r["ttype"], r["bin"]): r for r in scoring.fixed_bins(units, [0.0, 0.3, 0.5], ["ttype"], 5).collect()}
    assert a.keys() == b.keys() and all(a[k]["n"] == b[k]["n"] and a[k]["mean_pred"] == pytest.approx(b[k]["mean_pred"], abs=1e-12) and a[k]["obs_freq"] == pytest.approx(b[k]["obs_freq"], abs=1e-12) for k in a)
    x = field.select("race_id", F.col("driver_id").alias("a"), F.col("u").alias("ua"), F.col("finish").alias("finish_a"))
    pairs = x.join(x.toDF("race_id", "b", "ub", "finish_b"), "race_id").filter("a < b")
    s = F.col("a") + F.col("b")
    pairs = pairs.withColumn("p", F.when(s % 13 == 0, None).when(s % 17 == 0, 0.5).otherwise(F.round(1 / (1 + F.exp(F.col("ub") - F.col("ua"))), 6)))
    order = ["race_id", "n", "right", "ties", "missing", "even", "accuracy"]
    assert sorted(map(tuple, pair_blocks.pair_accuracy(field, 13, 17, piece=7).select(order).collect())) == sorted(map(tuple, scoring.h2h_accuracy(pairs, ["race_id"]).select(order).collect()))


@pytest.mark.parametrize("spread", [1, 6, 900])
def test_pair_sums_take_few_steps_a_pair(monkeypatch, spread):
    """chances at and over the bounds, shares of zero, and utilities whose powers of e leave the doubles, by tiles and blocks."""
    monkeypatch.setattr(pair_blocks, "TILE", 64)
    rng = np.random.default_rng(10)
    u, s = np.round(rng.normal(size=300) * spread, 9), rng.random(300) * (rng.random(300) > 0.1)
    s[:40] *= 1e-4
    want = np.zeros(5)
    for i in range(len(u) - 1):
        with np.errstate(over="ignore"):
            model = pair_blocks._cut(1 / (1 + np.exp(u[i + 1 :] - u[i])), 0.001)
        both = s[i] + s[i + 1 :]
        base = pair_blocks._cut(np.where(s[i + 1 :] == s[i], 0.5, s[i] / np.where(both == 0, 1, both)), 0.001)
        want += [len(both), ((1 - model) ** 2).sum(), ((1 - base) ** 2).sum(), -np.log(model).sum(), -np.log(base).sum()]
    a, b = ((u[k], s[k]) for k in (slice(0, 110), slice(110, None)))
    with np.errstate(all="ignore"):
        assert pair_blocks._totals((u, s), (u, s), True, 0.001) == pytest.approx(want, rel=1e-12)
        assert sum(pair_blocks._totals(x, y, x is y, 0.001) for x, y in ((a, a), (a, b), (b, b))) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("pieces", [1, 3])
def test_mean_chances_without_a_pair(spark, pieces):
    """each entrant met all others of its contest as rows; with far utilities, rows of one entrant, null utilities and a field of one."""
    rng = np.random.default_rng(11)
    rows = [(r, d, float(u)) for r, n, spread in ((1, 200, 1), (2, 90, 60), (3, 2, 1), (4, 1, 1), (5, 60, 3000)) for d, u in enumerate(np.round(rng.normal(size=n) * spread, 9))]
    rows += [(1, 7, 0.25), (1, 7, -3.0), (1, 8, None), (1, 500, None), (2, 5, 0.0)]
    field = spark.createDataFrame(rows, "race_id int, driver_id long, u double")
    want = pricing.h2h_prob(field).groupBy("race_id", F.col("a").alias("driver_id")).agg(F.avg("p").alias("mean_p"), F.count("*").alias("n")).collect()
    got = pricing.h2h_mean(field, pieces)
    assert got.count() == len(want) == 200 + 90 + 2 + 60 + 1
    got = {(r["race_id"], r["driver_id"]): r for r in got.collect()}
    for w in want:
        r = got[w["race_id"], w["driver_id"]]
        assert r["n"] == w["n"] and (r["mean_p"] is None if w["mean_p"] is None else abs(r["mean_p"] - w["mean_p"]) < 1e-14)


@pytest.mark.parametrize("digits, piece", [(9, 7), (0, 7), (1, 1000)])
def test_bins_of_pairs_are_those_of_all_pairs_in_order(spark, digits, piece):
    """All pairs were sorted as rows. With few digits most pairs have the chance of others, so bins end among ties; some ids come twice."""
    rng = np.random.default_rng(12)
    rows = [(r, int(d), float(u), int(f) + 1, float(rng.integers(1, 4))) for r, n in ((1, 31), (2, 18), (3, 1), (4, 44), (5, 2)) for d, f, u in zip(rng.permutation(3 * n), rng.permutation(n), np.round(rng.normal(size=n) * 3, digits))]
    rows += [(1, rows[0][1], rows[0][2] + 0.5, 40, 1.0), (5, 900, -400.0, 3, 1.0)]
    field = spark.createDataFrame(rows, "race_id int, driver_id long, u double, finish int, win_share double")
    cell = F.when(F.col("race_id") <= 2, "x").when(F.col("race_id") <= 4, "y").otherwise("z")
    groups = [("all", "x"), ("all", "y"), ("all", "z"), ("two", "x"), ("two", "y"), ("few", "z"), ("x", "x")]
    groups = spark.createDataFrame(groups, "g string, cell string")
    units = scoring.pair_units(field).withColumn("cell", cell).join(groups, "cell")
    want = {(r["g"], r["bin"]): r for r in scoring.equal_mass_bins(units, ["g"], ["race_id", "id", "id2"]).collect()}
    got = {(r["g"], r["bin"]): r for r in pair_bins.pair_bins(field.withColumn("cell", cell), "cell", groups, piece=piece).collect()}
    assert got.keys() == want.keys() and len(got) > 30
    for k, w in want.items():
        assert (got[k]["n"], got[k]["obs_freq"]) == (w["n"], pytest.approx(w["obs_freq"], abs=1e-12)) and got[k]["mean_pred"] == pytest.approx(w["mean_pred"], abs=1e-12)


def test_accuracy_without_a_pair():
    """each pair was looked at. Chances at and about the bounds of one half, many ties, ids that come twice, other multiples."""
    rng, million = np.random.default_rng(13), 1_000_000
    spreads = [lambda n: np.round(rng.normal(size=n), 9), lambda n: rng.integers(-4, 5, n) * 1e-6 + 0.3, lambda n: np.round(rng.normal(size=n), 1), lambda n: np.round(rng.integers(-3, 4, n) * 2e-6 + rng.normal() * 3, 9)]
    for turn in range(80):
        n = int(rng.integers(1, 90))
        ids, u, f = np.sort(rng.integers(0, 300, n)), spreads[turn % 4](n), (rng.permutation(n) + 1) // (2 if turn % 3 else 7)
        for missing, even in ((13, 17), (4, 6)):
            want = np.zeros(5, dtype=np.int64)
            for i in range(n - 1):
                s, p, tie = ids[i] + ids[i + 1 :], np.floor(million / (1 + np.exp(u[i + 1 :] - u[i])) + 0.5), f[i] == f[i + 1 :]
                none = s % missing == 0
                half = ((s % even == 0) | (p == million // 2)) & ~none
                graded = ~(tie | none | half)
                want += [graded.sum(), (graded & ((p > million // 2) == (f[i] < f[i + 1 :]))).sum(), tie.sum(), none.sum(), (half & ~tie).sum()]
            assert pair_blocks._accuracy(ids, u, f, missing, even) == want.tolist()


def test_pairs_of_blocks_are_all_pairs(spark):
    """each pair once, the smaller first, equal ones left out, wherever the blocks are cut."""
    rows = [(r, d, d // 2, float(d * r)) for r, n in ((1, 23), (2, 7), (3, 1), (4, 14)) for d in range(n)]
    field = spark.createDataFrame(rows, "race_id int, driver_id long, place int, u double")
    for order, at in (("driver_id", 1), ("place", 2)):
        got = sorted(map(tuple, pair_blocks.pairs(field, ["driver_id", "place", "u"], order, piece=7).collect()))
        assert got == sorted((a[0], *a[1:], *b[1:]) for a in rows for b in rows if a[0] == b[0] and a[at] < b[at])


@pytest.mark.parametrize("made", [scoring.pair_units, pricing.odds_sheet])
def test_pairs_are_made_by_many_tasks(spark, made):
    """the few bytes of a field went to one task, which made all pairs of all contests."""
    rows = [(r, d, float(d % 7), 0.5, d + 1, d + 1) for r in range(8) for d in range(60)]
    field = spark.createDataFrame(rows, "race_id int, driver_id long, u double, win_share double, finish int, start int")
    t = made(field)
    t = t.filter("kind = 'pair'") if "kind" in t.columns else t
    by = [r["count"] for r in t.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(by) == 8 * 60 * 59 // 2 and max(by) <= sum(by) / 2


def test_means_at_many_half_lives_are_those_at_each(spark):
    """over several blocks of the shortest half-life, with gaps."""
    rng = np.random.default_rng(8)
    rows = [(d, k, None if rng.random() < 0.2 else float(rng.normal() + 3)) for d, n in ((1, 2500), (2, 40), (3, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "driver_id int, race_seq int, x double")
    half_lives = {"a": 1, "b": 2, "c": 8, "d": 300}
    t = history.hl_means_prior(df, F.col("x"), half_lives, ["driver_id"], ["race_seq"], "n")
    for name, hl in half_lives.items():
        t = history.hl_mean_prior(t, F.col("x"), f"{name}_one", ["driver_id"], ["race_seq"], hl, count="n_one")
    for r in t.collect():
        assert r["n"] == r["n_one"]
        for name in half_lives:
            assert (r[name] is None and r[f"{name}_one"] is None) if r["n"] == 0 else r[name] == pytest.approx(r[f"{name}_one"], rel=1e-12)


def test_grid_of_configurations_is_each_one_alone(spark):
    """a task held the sorts of every value and half-life at once."""
    rng = np.random.default_rng(9)
    rows = [(100 + s, s, d, int(f) + 1, int(rng.integers(1, 5)), None if rng.random() < 0.3 else float(rng.integers(0, 4))) for s in range(1, 13) for d, f in enumerate(rng.permutation(9)) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "race_id int, race_seq int, driver_id int, finish int, start int, gap double")
    values, half_lives, burns, least = ["finish", "start", "gap"], [1, 2, 9], [2, 6], [1, 4]
    t = rank_model.config_grid(df, values, half_lives, burns, least, field=4)
    assert t._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 8  # three for each of two runs of half-lives, two for the ranks
    got = {(r["value"], r["half_life"], r["burn"], r["least"]): (r["mean_rho"], r["n"]) for r in t.collect()}
    want = {}
    for v in values:
        for hl in half_lives:
            h = history.hl_mean_prior(df, F.col(v), "f", ["driver_id"], ["race_seq"], hl, count="k").filter("f is not null").toPandas()
            for b in burns:
                for k in least:
                    rho = [x.f.round(9).rank().corr(x.finish.rank()) for _, x in h[(h.race_seq > b) & (h.k >= k)].groupby("race_id") if len(x) >= 4]
                    if rho:
                        want[v, hl, b, k] = (np.nanmean(rho), len(rho))
    assert got.keys() == want.keys()
    for key, (mean, n) in want.items():
        assert got[key][1] == n and got[key][0] == pytest.approx(mean, abs=1e-9)
