"""Contests cut into segments give the rows of whole contests, and refits on earlier contests those of a plain least squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacegrid.functions.segments import largest, segmented
from pacegrid.operators import laps as L
from pacegrid.operators import pricing as P
from pacegrid.operators import rank_model as M


def field(n=300, seed=5):
    """One contest with most of the rows, small ones beside it, and one of a single entrant."""
    rng = np.random.default_rng(seed)
    rows = []
    for race, size in ((1, n), (2, 7), (3, 1), (4, 40)):
        u, x = rng.normal(size=size) * 3, rng.normal(size=size)
        rows += [(race, d + 1, int(place) + 1, float(u[d]), float(x[d])) for d, place in enumerate(rng.permutation(size))]
    return rows


SCHEMA = "race_id int, driver_id int, finish int, u double, x double"


@pytest.mark.parametrize("hessian", [False, True])
@pytest.mark.parametrize("piece", [1, 16, 1000])
def test_likelihood_of_a_cut_contest(spark, piece, hessian):
    df = spark.createDataFrame(field(), SCHEMA)
    whole = M.pl_terms(df, ["x", "u"], F.col("u"), ["race_id"], hessian)
    cut = M.pl_terms(df, ["x", "u"], F.col("u"), ["race_id"], hessian, piece)
    a, b = (t.toPandas().sort_values("race_id") for t in (whole, cut))
    assert list(a.columns) == list(b.columns)
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


def test_pieces_are_due_by_the_largest_field(spark):
    df = spark.createDataFrame(field(), SCHEMA)
    assert (M.field_piece(df), M.field_piece(df, 299), M.field_piece(df.limit(0))) == (None, 299, None)
    assert (largest(df, ["race_id"]), largest(df.limit(0), ["race_id"])) == (300, 0)


@pytest.mark.parametrize("pieces", [2, 50])
def test_win_probability_of_a_cut_field(spark, pieces):
    df = spark.createDataFrame(field(), SCHEMA)
    whole, cut = P.win_prob(df), P.win_prob(df, pieces)
    assert sorted(whole.columns) == sorted(cut.columns)
    a, b = (t.select(*SCHEMA.replace("int", "").replace("double", "").replace(" ", "").split(","), "p_win").toPandas().sort_values(["race_id", "driver_id"]) for t in (whole, cut))
    np.testing.assert_allclose(a, b, rtol=1e-12)


def test_gap_ahead_across_segments(spark):
    """Ties of the clock, a contest of one clock alone, null clocks, and most rows in one contest."""
    rng = np.random.default_rng(2)
    rows = [(1, int(d), int(k), float(rng.integers(1, 120))) for d in range(12) for k in range(40)] + [(2, d, 1, 5.0) for d in range(60)] + [(3, 1, 1, None), (3, 2, 1, 9.0)]
    df = spark.createDataFrame(rows, "race_id int, driver_id int, lap int, clock double")
    key = ["race_id", "clock", "driver_id", "lap"]
    plain = df.toPandas().dropna(subset=["clock"]).sort_values(key)
    plain["gap"] = plain["clock"] - plain.groupby("race_id")["clock"].shift()
    for piece in (10, 64, 10_000):
        got = L.gap_ahead(df, piece=piece).toPandas().sort_values(key)
        assert sorted(got.columns) == sorted([*df.columns, "gap", "dirty"])
        np.testing.assert_array_equal(got[[*key, "gap"]], plain[[*key, "gap"]])
    parts = segmented(df, "clock", ["race_id"], piece=64).groupBy("race_id").agg(F.countDistinct("_segment").alias("n"))
    assert {r["race_id"]: r["n"] > 3 for r in parts.collect()} == {1: True, 2: False, 3: False}
    assert L.gap_ahead(df.limit(0)).count() == 0


def test_refits_on_earlier_contests(spark):
    rng = np.random.default_rng(8)
    rows = [("a" if q % 3 else "b", q, *map(float, rng.normal(size=4))) for q in range(1, 9) for _ in range(4)]
    df = spark.createDataFrame(rows, "venue string, race_seq int, z_start double, fin_h double, pace_h double, z_finish double")
    got = {(r["venue"], r["race_seq"]): r for r in L.ols_prior_effect(df, ["venue"]).collect()}
    assert set(got) == {(r[0], r[1]) for r in rows}
    for (venue, q), r in got.items():
        prior = np.array([x[2:] for x in rows if x[0] == venue and x[1] < q])
        assert r["n"] == len(prior)
        if len(prior) < 5:
            assert r["beta"] is None
        else:
            x = np.column_stack([np.ones(len(prior)), prior[:, :3]])
            assert r["beta"] == pytest.approx(np.linalg.lstsq(x, prior[:, 3], rcond=None)[0][1], abs=1e-8)
