"""Walk-forward fits against a plain NumPy fit of each cut, and the small operators of this kind on rows with gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacegrid.operators import quality as Q
from pacegrid.operators import rank_model as M
from pacegrid.operators import scoring as D

SPECS = {"one": ["x"], "both": ["x", "y"]}


def contests(n=14, field=6, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for r in range(1, n + 1):
        x, y = rng.normal(size=field), rng.normal(size=field)
        order = np.argsort(-(x + 0.5 * y + rng.gumbel(size=field)))
        out += [(100 + r, r, int(d), place + 1, float(x[d]), float(y[d])) for place, d in enumerate(order)]
    return out


SCHEMA = "race_id int, race_seq int, driver_id int, finish int, x double, y double"


def plain_fit(rows, columns, ridge=0.5):
    """The minimum by Newton's method, contest by contest in finish order."""
    w = np.zeros(len(columns))
    races = {}
    for r in rows:
        races.setdefault(r[0], []).append(r)
    for _ in range(60):
        g, h = 2 * ridge * w, 2 * ridge * np.eye(len(w))
        for race in races.values():
            x = np.array([[r[c] for c in columns] for r in sorted(race, key=lambda r: r[3])])
            for k in range(len(x)):
                p = np.exp(x[k:] @ w)
                p /= p.sum()
                mean = p @ x[k:]
                g = g + mean - x[k]
                h = h + (x[k:] * p[:, None]).T @ x[k:] - np.outer(mean, mean)
        w = w - np.linalg.solve(h, g)
    return w


@pytest.mark.parametrize("every", [1, 3])
def test_walk_forward_equals_a_plain_fit_of_each_cut(spark, every):
    rows = contests()
    got = M.pl_walk_forward(spark.createDataFrame(rows, SCHEMA), SPECS, least=8, every=every).collect()
    assert {(r["spec"], r["race_seq"]) for r in got} == {(s, q) for s in SPECS for q in range(9, 15)}
    for spec, columns in (("one", [4]), ("both", [4, 5])):
        for q in range(9, 15):
            w = plain_fit([r for r in rows if r[1] < 9 + (q - 9) // every * every], columns)
            for r in (r for r in got if r["spec"] == spec and r["race_seq"] == q):
                x = next(t for t in rows if t[1] == q and t[2] == r["driver_id"])
                assert r["u"] == pytest.approx(sum(k * x[c] for k, c in zip(w, columns)), abs=1e-6)


def test_walk_forward_scores_identical_contests_and_is_flat(spark):
    rows = contests()
    rows[-1] = (*rows[-1][:5], None)  # lacks a feature of one set: out of both
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.pl_walk_forward(df, SPECS, least=8)
    assert {r["n"] for r in got.groupBy("spec").agg(F.count("*").alias("n")).collect()} == {6 * 6 - 1}
    assert max(r["gradient"] for r in M.walk_forward_gradient(df, SPECS, least=8).collect()) < 1e-5


def test_walk_forward_without_enough_contests(spark):
    df = spark.createDataFrame(contests(3), SCHEMA)
    assert M.pl_walk_forward(df, SPECS, least=8).count() == 0
    assert M.pl_walk_forward(df.limit(0), SPECS, least=8).count() == 0
    assert M.walk_forward_gradient(df, SPECS, least=8).count() == 0


def test_first_contest_can_be_scored_by_no_others(spark):
    got = M.pl_walk_forward(spark.createDataFrame(contests(2), SCHEMA), SPECS, least=0).filter("race_seq = 1").collect()
    assert {r["u"] for r in got} == {0.0}


def gate(spark, values):
    return M.paired_gate(spark.createDataFrame([(v,) for v in values], "d double"), F.col("d")).first()


def test_paired_gate(spark):
    up = gate(spark, [0.01 * k for k in range(1, 11)])
    assert up["verdict"] == "adopt" and up["p"] == pytest.approx(1 / 1024)
    assert gate(spark, [0.0001 * k for k in range(1, 11)])["verdict"] == "keep"  # sure, but too small a lift
    assert gate(spark, [0.5, -0.4, None])["verdict"] == "keep"
    assert gate(spark, [])["verdict"] == "keep"


def test_stratum_bundle(spark):
    rng = np.random.default_rng(2)
    rows = [("win", "a" if k % 3 else None, 1995 + k % 6, k // 5, k, float(p), 0.4, int(rng.random() < p)) for k, p in enumerate(rng.uniform(0.1, 0.9, 300))]
    units = spark.createDataFrame(rows, "market string, kind string, year int, race_id int, id int, p_model double, p_base double, outcome int")
    got = {(r["stratum"], r["kind"], r["metric"]): r["value"] for r in D.stratum_bundle(units, {"all": F.lit(True), "late": F.col("year") > 1997}, "kind", ["race_id", "id"]).collect()}
    assert {k[:2] for k in got} == {(s, t) for s in ("all", "late") for t in ("all", "a")}
    for s, t in {k[:2] for k in got}:
        of = [r for r in rows if (s == "all" or r[2] > 1997) and (t == "all" or r[1] == t)]
        p, o = np.array([r[5] for r in of]), np.array([r[7] for r in of])
        assert got[s, t, "n"] == len(of)
        assert got[s, t, "bss"] == pytest.approx(1 - ((p - o) ** 2).mean() / ((0.4 - o) ** 2).mean())
        order = np.argsort(p)
        cells = [order[len(of) * i // 10 : len(of) * (i + 1) // 10] for i in range(10)]
        assert got[s, t, "reliability"] == pytest.approx(sum(len(c) * (p[c].mean() - o[c].mean()) ** 2 for c in cells) / len(of))


def test_required_phrases_and_coverage(spark):
    docs = spark.createDataFrame([(1, "The Terms\napply"), (2, None), (3, "")], "id int, text string")
    assert {tuple(r) for r in Q.required_phrases(docs, "id", "text", ["terms", "APPLY", "not there"]).collect()} == {(1, "not there")} | {(k, p) for k in (2, 3) for p in ("terms", "APPLY", "not there")}
    ranges = spark.createDataFrame([("v", 2000, 2001), ("v", 2003, 9999), ("w", 2002, 2002)], "name string, first_year int, last_year int")
    active = spark.createDataFrame([("v", 2001), ("v", 2002), ("v", 2002), ("v", 2010), ("w", 2003), ("x", 2000)], "name string, year int")
    assert {tuple(r) for r in Q.uncovered_years(ranges, active).collect()} == {("v", 2002), ("w", 2003), ("x", 2000)}
    stored = spark.createDataFrame([(1, 1, None), (2, 2, 0), (3, 1, 2), (4, 2, None), (5, 3, -1), (6, None, None)], "id int, nth int, gap int")
    assert {tuple(r) for r in Q.gap_rules(stored, "id", "nth", "gap").collect()} == {(3, "debut"), (4, "debut"), (5, "negative"), (6, "debut")}
