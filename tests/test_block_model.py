"""The block model against a dense NumPy fit and search, and graph and inversion operators against plain versions."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pacegrid.functions.inversions import discordant, inversions, pair_counts
from pacegrid.operators import block_model as B
from pacegrid.operators import rank_model as M
from pacegrid.operators import scoring as D

FACTORS = ["driver_id", "team_name", "make"]


def races(n_races=24, n_drivers=9, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for r in range(n_races):
        field = rng.permutation(n_drivers)[: int(rng.integers(5, n_drivers + 1))]
        skill = field * 0.3 + rng.normal(0, 1, len(field))
        for place, i in enumerate(np.argsort(-skill)):
            d = int(field[i])
            team = d // 3 if r % 6 else (d + 1) // 3  # some drive for another team now and then
            out.append((r, d, place + 1, 2000 + r % 3, f"t{team}", None if team == 2 else f"m{team % 2}"))
    return out


SCHEMA = "race_id int, driver_id int, finish int, year int, team_name string, make string"


def dense(rows, lambdas, keep=lambda r: True):
    """The minimum by Newton's method on all dummies; {(factor, entity): worth}."""
    names = sorted({(f, str(r[c]) if r[c] is not None else "") for r in rows for f, c in (("driver_id", 1), ("team_name", 4), ("make", 5))})
    at = {x: k for k, x in enumerate(names)}
    ridge = np.array([lambdas[f] for f, _ in names])
    x = lambda r: [at["driver_id", str(r[1])], at["team_name", r[4]], at["make", r[5] or ""]]
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2])):
        if keep(r):
            by.setdefault(r[0], []).append(x(r))
    w = np.zeros(len(names))
    for _ in range(30):
        g, h = 2 * ridge * w, np.diag(2 * ridge)
        for idx in by.values():
            z = np.zeros((len(idx), len(names)))
            for k, i in enumerate(idx):
                z[k, i] += 1
            e = np.exp(z @ w)
            for k in range(len(idx)):
                p = e[k:] / e[k:].sum()
                m = p @ z[k:]
                g += m - z[k]
                h += (z[k:] * p[:, None]).T @ z[k:] - np.outer(m, m)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    return dict(zip(names, w))


def nll(rows, w):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2])):
        by.setdefault(r[0], []).append(w["driver_id", str(r[1])] + w["team_name", r[4]] + w["make", r[5] or ""])
    return sum(float(np.log(np.exp(u[k:]).sum()) - u[k]) for u in map(np.array, by.values()) for k in range(len(u)))


@pytest.mark.parametrize("lambdas", [(3.0, 10.0, 30.0), (0.5, 0.2, 0.1)])
def test_worths_are_those_of_a_dense_fit(spark, lambdas):
    rows = races()
    of = dict(zip(FACTORS, lambdas))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = B.block_pl_fit(df, FACTORS, of, tol=1e-7)
    worth = {(r["factor"], r["entity"]): r["worth"] for r in got.collect()}
    want = dense(rows, of)
    assert worth.keys() == want.keys() and all(worth[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    assert B.block_gradient(df, FACTORS, got, of).agg(F.max(F.abs("gradient"))).first()[0] < 1e-4


def test_lambda_search_is_that_of_a_dense_search(spark):
    rows, grid = races(16, 6), [0.3, 3.0]
    known = {}

    def value(of):
        key = tuple(of.values())
        if key not in known:
            known[key] = sum(nll([r for r in rows if r[3] == y], dense(rows, of, lambda r: r[3] != y)) for y in (2000, 2001, 2002))
        return known[key]

    best = dict.fromkeys(FACTORS, 3.0)
    for _ in range(4):
        before = dict(best)
        for f in FACTORS:
            best[f] = min(grid, key=lambda x: (round(value(best | {f: x}), 6), -x))
        if best == before:
            break
    assert B.cv_select_lambda(spark.createDataFrame(rows, SCHEMA), FACTORS, grid, tol=1e-3) == best


def test_inversions_without_pairs(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 50, 129):
        v = [rng.randrange(12) for _ in range(n)]
        assert inversions(np.array(v)) == sum(v[i] > v[j] for i in range(n) for j in range(i + 1, n))
    rows = [(g, rng.randrange(9), None if rng.random() < 0.1 else rng.randrange(9) / 2) for g in (1, 2, None) for _ in range(60)] + [(5, 1, 1.0)]
    df = spark.createDataFrame(rows, "g int, a int, b double")
    pairs = {}
    for g in (1, 2, None, 5):
        own = [(a, b) for k, a, b in rows if k == g and b is not None]
        two = list(itertools.combinations(own, 2))
        off = [(p, q) for p, q in two if (p[0] - q[0]) * (p[1] - q[1]) < 0]
        pairs[g] = (len(off), sum(abs(p[0] - q[0]) >= 2 and abs(p[1] - q[1]) >= 2 for p, q in off))
    for ranges in (None, 4, 9):
        assert {r["g"]: r["discordant"] for r in discordant(df, "a", "b", ["g"], ranges).collect()} == {g: x for g, (x, _) in pairs.items()}
        assert {r["g"]: r["discordant"] for r in discordant(df, "a", "b", ["g"], ranges, gap=2).collect()} == {g: y for g, (_, y) in pairs.items()}
    got = {r["g"]: r for r in pair_counts(df.filter("g is not null"), "a", "b", ["g"]).collect()}
    own = [(a, b) for k, a, b in rows if k == 1 and b is not None]
    two = list(itertools.combinations(own, 2))
    assert got[1]["concordant"] == sum((p[0] - q[0]) * (p[1] - q[1]) > 0 for p, q in two) and got[1]["tied_both"] == sum(p == q for p, q in two)


def plain_components(edges):
    nodes = sorted({x for e in edges for x in e})
    reach = {n: {n} for n in nodes}
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    for n in nodes:
        stack = [n]
        while stack:
            for b in out[stack.pop()]:
                if b not in reach[n]:
                    reach[n].add(b)
                    stack.append(b)
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "two rings"])
def test_strong_components(spark, kind):
    rng = random.Random(7)
    if kind == "random":
        edges = [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(45)]
    elif kind == "ring":
        edges = [(f"n{k:02d}", f"n{(k + 1) % 40:02d}") for k in range(40)]
    else:
        edges = [(f"a{k}", f"a{(k + 1) % 5}") for k in range(5)] + [(f"b{k}", f"b{(k + 1) % 7}") for k in range(7)] + [("a1", "x"), ("x", "b3"), ("b3", "y"), ("y", "y")]
    got = {r["node"]: r["component"] for r in M.strong_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == plain_components(edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, writes = 2000, []
    kept = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name: (writes.append(name), kept(df, name))[1])
    edges = spark.createDataFrame([(f"{k:05d}", f"{k + 1:05d}") for k in range(n)], "a string, b string")
    got = M.strong_components(edges).agg(F.count("*"), F.countDistinct("component")).first()
    assert tuple(got) == (n + 1, n + 1) and writes.count("chains") < 40 and writes.count("colours") == 0


def test_connectivity_names_those_outside(spark):
    # a, b, c beat each other in turn; x is always last; solo runs alone
    rows = [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "x"), (2, 1, "b"), (2, 2, "c"), (2, 3, "a"), (2, 4, "x"), (3, 1, "solo")]
    df = spark.createDataFrame([(r, f, e, 2001) for r, f, e in rows], "race_id int, finish int, driver string, year int")
    got = {r["window"]: r for r in M.connectivity(df, ["driver"], "year").collect()}
    for w in ("pooled", "2001"):
        assert (got[w]["n_entities"], got[w]["n_components"], got[w]["connected"], got[w]["outside"]) == (5, 3, False, "solo,x")


def test_tree_splits_where_groups_part(spark):
    near = lambda a, b: 0.9 if (a < 4) == (b < 4) else 0.1
    pairs = spark.createDataFrame([(f"v{a}", f"v{b}", near(a, b)) for a in range(8) for b in range(a + 1, 8)], "a string, b string, sim double")
    cov = spark.createDataFrame([(f"v{k}", "size", float(k)) for k in range(8)] + [(f"v{k}", "gap", None if k == 1 else float(-k)) for k in range(8)], "venue string, name string, value double")
    leaves, splits = M.partition_tree(pairs, cov)
    assert [(r["node"], r["name"], r["threshold"], r["n_left"], r["n_right"]) for r in splits.collect()] == [(1, "size", 3.5, 4, 4)]
    assert {r["venue"]: r["leaf"] for r in leaves.collect()} == {f"v{k}": 2 if k < 4 else 3 for k in range(8)}
    labels = spark.createDataFrame([(f"v{k}", "x" if k < 3 else "y") for k in range(7)], "venue string, label string")
    got = {r["venue"]: (r["leaf"], r["size"], r["majority"], r["agrees"]) for r in M.leaf_labels(leaves, labels).collect()}
    assert got["v0"] == (2, 4, "x", True) and got["v3"] == (2, 4, "x", False) and got["v7"] == (3, 4, "y", None)


def test_looks_are_states_of_prefixes(spark):
    rng = np.random.default_rng(1)
    picks = spark.createDataFrame([(int(r), float(x)) for r in range(12) for x in rng.normal(0, 1, 1 + r % 3)], "race_id int, profit double")
    looks = {r["look"]: r for r in D.sequential_looks(picks, 50).collect()}
    for k in (1, 5, 12):
        one = D.roi_state(picks.filter(F.col("race_id") < k).withColumn("side", F.lit("s")), ["side"], 50).first()
        assert all(looks[k][c] == pytest.approx(one[c]) if one[c] is not None else looks[k][c] is None for c in ("N", "K", "total", "roi", "p_boot", "bound", "t"))


def test_a_contest_and_a_block_exchange_one_row(spark):
    fitter = B.Fitter(spark.createDataFrame(races(), SCHEMA), FACTORS)
    try:
        assert fitter.base.count() == 24  # before: a row an entrant and role
    finally:
        fitter.close()


def test_fits_are_worked_through_in_parts(spark, monkeypatch):
    """A task held an entrant's numbers in all fits at once, and a dict of Python for each of a contest's entrants."""
    some = [B.Fit((3.0, 10.0, 30.0)), B.Fit((1.0, 10.0, 30.0), "2001"), B.Fit((0.3, 1.0, 3.0), "2000"), B.Fit((3.0, 1.0, 10.0)), B.Fit((9.0, 3.0, 1.0), "2002")]
    got = []
    for part in (2, 8):
        monkeypatch.setattr(B, "PART", part)
        fitter = B.Fitter(spark.createDataFrame(races(), SCHEMA), FACTORS, "year", len(some))
        try:
            state, held = fitter.fit(some, steps=3)
            got.append((dict(((r["factor"], r["entity"]), r["worth"]) for r in fitter.worths(state, len(some)).collect()), held))
        finally:
            fitter.close()
    (a, held), (b, other) = got
    assert a.keys() == b.keys() and held == pytest.approx(other, rel=1e-9)
    assert all(a[x] == pytest.approx(b[x], rel=1e-8, abs=1e-10) for x in a)


def test_links_come_as_arrays_of_numbers():
    """F10, F12, F16."""
    links = {"at": [np.array([5, 2, 5], np.int32)], "owner": [np.array([1, 0, 1], np.int32)], "pos": [np.array([0, 0, 1], np.int32)]}
    (row,) = next(B._packed(iter([pd.DataFrame({"race_id": [1], "block": [0], "fold": ["x"], **links})]))).to_dict("records")
    assert np.frombuffer(row["ids"], np.int32).tolist() == [2, 5] and np.frombuffer(row["of"], np.int32).tolist() == [1, 0, 1]
    assert np.frombuffer(row["pos"], np.int32).tolist() == [0, 0, 1] and np.frombuffer(row["owner"], np.int8).tolist() == [0, 1]
