"""Operators on small literal inputs with known results."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pacegrid.functions import stats
from pacegrid.operators import archive, conform, history, laps, pricing, quality, rank_model, scoring
from pacegrid.sources import tables

FIELD = [101, 102, 103, 104, 105]


def pairs_of(spark, finish, p=0.6):
    rows = [(1, a, b, finish[a], finish[b], p) for a in FIELD for b in FIELD if a < b]
    return spark.createDataFrame(rows, "race_id int, a int, b int, finish_a int, finish_b int, p double")


@pytest.mark.parametrize("finishes, rho, accuracy", [((1, 3, 2, 4, 5), 0.9, 0.9), ((4, 1, 2, 3, 5), 0.4, 0.7)])
def test_forecast_scores(spark, finishes, rho, accuracy):
    ranks = spark.createDataFrame([(1, k + 1, f) for k, f in enumerate(finishes)], "race_id int, predicted int, finish int")
    assert rank_model.spearman_by(ranks, "predicted", "finish", ["race_id"]).first()["rho"] == pytest.approx(rho)
    got = scoring.h2h_accuracy(pairs_of(spark, dict(zip(FIELD, finishes))), ["race_id"]).first()
    assert (got["n"], got["accuracy"]) == (10, pytest.approx(accuracy))


def test_even_and_tied_pairs_are_counted_apart(spark):
    tied = scoring.h2h_accuracy(pairs_of(spark, dict(zip(FIELD, (1, 2, 2, 4, 5)))), ["race_id"]).first()
    assert (tied["n"], tied["ties"]) == (9, 1)
    even = pairs_of(spark, dict(zip(FIELD, (1, 2, 3, 4, 5)))).withColumn("p", F.when((F.col("a") == 102) & (F.col("b") == 103), 0.5).otherwise(F.col("p")))
    got = scoring.h2h_accuracy(even, ["race_id"]).first()
    assert (got["n"], got["even"]) == (9, 1)


def test_seal_breaks_when_a_field_changes(spark):
    doc = {"config": {"half_life": 8}, "field": [1, 2], "quotes": []}
    seal = scoring.canonical_hash(json.dumps(doc))
    filled, other = doc | {"quotes": [{"a": 1}]}, doc | {"field": [1, 3]}
    df = spark.createDataFrame([(json.dumps(filled), seal), (json.dumps(other), seal), ("not json", seal), (None, seal)], "payload string, sha256 string")
    assert [r["verified"] for r in scoring.verify_seal(df).collect()] == [True, False, False, False]


def test_quotes_are_cleaned_in_order(spark):
    q = [
        (1, 1, 101, 102, "-120", "100", False, 5, False),
        (1, 2, 102, 101, "110", "-130", True, 1, False),  # the closing one of the same pair
        (1, 3, 103, 104, "n/a", "100", True, 1, False),
        (1, 4, 103, 105, "0", "100", True, 1, False),
        (1, 5, 104, 105, "100", "100", True, 1, True),
    ]
    df = spark.createDataFrame(q, "race_id int, pos int, a int, b int, price_a string, price_b string, closing boolean, ts int, void boolean")
    assert {r["pos"]: r["state"] for r in scoring.clean_quotes(df).collect()} == {1: "deduped", 2: "kept", 3: "malformed", 4: "malformed", 5: "void"}


def test_upsert_twice_is_the_same(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "a")], "race_id int, v string"), spark.createDataFrame([(2, "b")], "race_id int, v string")
    once = tables.upsert_log(old, new, ["race_id"])
    assert sorted(once.collect()) == sorted(tables.upsert_log(once, new, ["race_id"]).collect()) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("text, expected", [("31 in turns; 18 in the tri-oval", (31, 18)), ("33; frontstretch 16.5", (33, 16.5)), (None, (None, None)), ("14-20", (20, None)), ("7", (7, None)), ("flat", (None, None))])
def test_banking_text(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in conform.parse_banking(F.col("t")).items()])
    assert tuple(df.first()) == expected


def test_toy_field_prices_cohere(spark):
    u = dict(zip(FIELD, (1.2, 0.5, 0.0, -0.3, -1.0)))
    make = dict(zip(FIELD, ("x", "y", "x", "z", "y")))
    f = spark.createDataFrame([(1, d, u[d], make[d], k + 1) for k, d in enumerate(FIELD)], "race_id int, driver_id long, u double, make string, start int")
    win = {r["driver_id"]: r["p_win"] for r in pricing.win_prob(f).collect()}
    e = np.exp(np.array(list(u.values())))
    np.testing.assert_allclose(list(win.values()), e / e.sum(), rtol=1e-12)
    h = {(r["a"], r["b"]): r["p"] for r in pricing.h2h_prob(f).collect()}
    assert all(h[a, b] + h[b, a] == pytest.approx(1) for a, b in h)
    got = quality.prob_coherence(pricing.win_prob(f), pricing.make_markets(f), pricing.topn_prob(pricing.draw_orders(f, 500), 500, [1, 3]), ["p_top1", "p_top3"]).first()
    assert got["sums_to_one"] and got["makes_match"] and got["monotone"]
    odds = spark.createDataFrame([(0.5,), (0.6,), (0.25,)], "p double").select(pricing.american(F.col("p")).alias("q"))
    assert [r["q"] for r in odds.collect()] == [100, -150, 300]


def test_invariants_find_planted_faults(spark):
    r = [(100, 1, 1), (100, 2, 2), (101, 1, 1), (101, 2, 1), (102, 1, 2), (102, 2, 3), (103, 17, 1), (103, 17, 2)]
    df = spark.createDataFrame(r, "race_id int, driver_id int, finish int")
    assert sorted(x["race_id"] for x in quality.one_winner(df, "race_id", "finish").collect()) == [101, 102]
    assert [tuple(x) for x in quality.duplicate_keys(df, ["race_id", "driver_id"]).collect()] == [(103, 17, 2)]


def test_recency_mean_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(history, "BLOCK", 64)
    n, hl = 200, 2.0
    values = np.random.default_rng(0).normal(size=n)
    values[::7] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": range(n), "v": values})).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = history.hl_mean_prior(df, F.col("v"), "m", ["k"], ["t"], hl, count="n").orderBy("t").toPandas()
    for t in range(n):
        past = [x for x in values[:t] if x == x]
        assert got["n"][t] == len(past)
        if past:
            w = 2.0 ** (-np.arange(len(past))[::-1] / hl)
            assert got["m"][t] == pytest.approx(np.dot(w, past) / w.sum(), abs=1e-7)
        else:
            assert np.isnan(got["m"][t])


def test_newton_fit_has_no_gradient_left(spark):
    rng = np.random.default_rng(3)
    rows = []
    for race in range(12):
        x = rng.normal(size=(8, 2))
        order = np.argsort(-(x @ [0.8, -0.4] + rng.gumbel(size=8)))
        rows += [(race, race, int(d), int(np.where(order == d)[0][0]) + 1, float(x[d, 0]), float(x[d, 1])) for d in range(8)]
    df = spark.createDataFrame(rows, "race_id int, race_seq int, driver_id int, finish int, x0 double, x1 double")
    w = rank_model.pl_fit(df, ["x0", "x1"])
    g = rank_model.pl_terms(df, ["x0", "x1"], rank_model.utility(["x0", "x1"], w), []).first()
    assert abs(g["g_x0"] + w[0]) < 1e-5 and abs(g["g_x1"] + w[1]) < 1e-5
    scored = rank_model.pl_walk_forward(df, ["x0", "x1"], least=8)
    own = rank_model.pl_fit(df.filter("race_seq < 8"), ["x0", "x1"])
    first = scored.filter("race_seq = 8").join(df.select("race_id", "driver_id", "x0", "x1"), ["race_id", "driver_id"]).toPandas()
    np.testing.assert_allclose(first["u"], first[["x0", "x1"]] @ own, rtol=1e-5, atol=1e-6)


def test_fixed_effects_equal_dummy_regression(spark):
    rng = np.random.default_rng(5)
    rows, y, design = [], [], []
    for d in range(4):
        for k in range(30):
            x = rng.normal(size=6)
            v = 0.3 * d + x @ [0.1, -0.2, 0.3, 0.0, 0.5, -0.4] + rng.normal() * 0.01
            rows.append((1, d, float(v), *map(float, x)))
            y.append(v)
            design.append([*(float(d == j) for j in range(4)), *x])
    df = spark.createDataFrame(rows, "race_id int, driver_id int, y double, " + ", ".join(f"x{k} double" for k in range(6)))
    coef = np.linalg.lstsq(np.array(design), np.array(y), rcond=None)[0][:4]
    got = {r["driver_id"]: r["fepace"] for r in laps.fixed_effect_pace(df, 50, 4, 25).collect()}
    np.testing.assert_allclose([got[d] for d in range(4)], coef - coef.mean(), atol=1e-9)


def test_strong_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a")], "a string, b string")
    assert {tuple(r) for r in rank_model.strong_components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")}


def test_block_fit_gradient_is_small(spark):
    rng = np.random.default_rng(1)
    rows = [(r, int(d), k + 1) for r in range(20) for k, d in enumerate(rng.permutation(5))]
    df = spark.createDataFrame(rows, "race_id int, driver_id int, finish int")
    worth = {int(r["entity"]): r["worth"] for r in rank_model.block_pl_fit(df, ["driver_id"], {"driver_id": 2.0}, steps=24).collect()}
    u = spark.createDataFrame(list(worth.items()), "driver_id int, w double")
    t = df.join(u, "driver_id").withColumns({f"is{d}": F.when(F.col("driver_id") == d, 1.0).otherwise(0.0) for d in range(5)})
    g = rank_model.pl_terms(t, [f"is{d}" for d in range(5)], F.col("w"), []).first()
    assert max(abs(g[f"g_is{d}"] + 4.0 * worth[d]) for d in range(5)) < 1e-3


def test_ambiguous_crosswalk_is_an_error(spark):
    races = spark.createDataFrame([(1, "v", 2000, 3)], "race_id int, venue string, year int, month int")
    two = spark.createDataFrame([("v", 1995, 9999, None, "a"), ("v", 1999, 9999, None, "b")], "name string, first_year int, last_year int, months array<int>, track_id string")
    assert conform.range_join_xwalk(races, two).count() == 0  # neither has a month rule that fits
    fits = two.withColumn("months", F.array(F.lit(3)))
    with pytest.raises(Exception, match="ambiguous crosswalk"):
        conform.range_join_xwalk(races, fits).collect()


def test_ledger_and_archive_files(spark, tmp_path):
    assert tables.read_fetch_log(spark, str(tmp_path / "none.json")).count() == 0
    import gzip
    import hashlib

    d = tmp_path / "series_1" / "2024" / "5618" / "weekend"
    d.mkdir(parents=True)
    (d / "20240101T000000.json.gz").write_bytes(gzip.compress(b"{}"))
    files = tables.archive_files(spark, str(tmp_path)).collect()
    assert [(r["series"], r["race_id"], r["feed"], r["version"]) for r in files] == [(1, 5618, "weekend", "20240101T000000")]
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert archive.content_hashes(content).first()["found"] == hashlib.sha256(b"{}").hexdigest()


def test_p_values():
    assert stats.signed_rank_sf(15, 5) == pytest.approx(1 / 32)
    assert stats.student_sf(2.0, 10) == pytest.approx(0.036694, abs=1e-6)
    assert stats.student_sf(-1.0, 3) == pytest.approx(0.804499, abs=1e-6)
    assert stats.normal_sf(1.96) == pytest.approx(0.0249979, abs=1e-7)
