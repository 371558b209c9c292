"""Whitening of embeddings by the leading components of their covariance, found by spectrum slicing.

For a symmetric matrix A, the pivots of an LDLᵀ factorisation of A - s I that are positive are as many as A has eigenvalues above s
(Sylvester's law of inertia). Bisection on that count isolates each leading eigenvalue in an interval of its own, Rayleigh quotient
iteration from there converges cubically, and counts on both sides of what it found certify the number of the component.

Sums and the covariance are made on Spark: a task adds up its vectors and returns one row a tile of the matrix, which are added up
in two steps of streaming tasks; the driver meets the matrix once (8 dims² bytes) and slices it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_LIMB = 22  # bits of the parts in which exact sums are kept: 2^41 vectors fit
_EPS = float(np.finfo(np.float64).eps)


# ---- spectrum slicing, on the driver


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix `a` lie above `shift`: the positive pivots of LDLᵀ of a - shift I, with 1 x 1 and
    2 x 2 pivots (Bunch and Kaufman's choice). A 2 x 2 pivot has a negative determinant, so one eigenvalue of each sign."""
    m = a - shift * np.eye(len(a))
    alpha, count = (1 + math.sqrt(17)) / 8, 0
    while len(m):
        below = np.abs(m[1:, 0])
        r = int(below.argmax()) + 1 if len(below) else 0
        most, first, size, swap = (below[r - 1] if len(below) else 0.0), abs(m[0, 0]), 1, 0
        if first < alpha * most:
            row = np.abs(m[r])
            row[r] = 0
            widest = row.max()
            if first * widest < alpha * most * most:
                size, swap = (1, r) if abs(m[r, r]) >= alpha * widest else (2, r)
        if swap:
            at = size - 1
            m[[at, swap]] = m[[swap, at]]
            m[:, [at, swap]] = m[:, [swap, at]]
        if size == 1:
            pivot, column = m[0, 0], m[1:, 0].copy()
            count += bool(pivot > 0)
            m = m[1:, 1:]
            if pivot != 0:
                m -= np.outer(column, column / pivot)
        else:
            count += 1
            block, columns = m[:2, :2].copy(), m[2:, :2].copy()
            m = m[2:, 2:]
            m -= columns @ np.linalg.solve(block, columns.T)
    return count


def _solve(a: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    for push in (0.0, _EPS, 4 * _EPS, 64 * _EPS):  # a shift that is an eigenvalue to the last bit is moved by a rounding
        try:
            x = np.linalg.solve(a - (shift + push) * np.eye(len(a)), b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return x
    return b


def rayleigh(a: np.ndarray, shift: float, found: list[np.ndarray], seed: int) -> tuple[float, np.ndarray]:
    """An eigenvalue and unit eigenvector near `shift` that is at right angles with those found: inverse iteration at the shift,
    then Rayleigh quotient iteration until the residual stops falling."""

    def clear(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max()
        for _ in range(2):
            for f in found:
                x = x - (f @ x) * f
        return x / np.sqrt(x @ x)

    v = clear(np.random.default_rng(seed).standard_normal(len(a)))
    for _ in range(3):
        v = clear(_solve(a, shift, v))
    value = float(v @ a @ v)
    best = (math.inf, value, v)
    for _ in range(30):
        residual = a @ v - value * v
        off = float(np.sqrt(residual @ residual))
        if off < best[0]:
            best = (off, value, v)
        elif best[0] < 64 * _EPS:
            break
        v = clear(_solve(a, value, v))
        value = float(v @ a @ v)
    return best[1], best[2]


def leading(covariance: np.ndarray, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns): the `most` largest eigenvalues of a covariance by falling size, fewer where its rank is less (values
    under dims roundings of the trace count as zero). Eigenvalues that agree to rounding are one cluster: their counts certify it as a whole."""
    trace = float(np.trace(covariance))
    dims = len(covariance)
    if not dims or not trace > 0:
        return np.zeros(0), np.zeros((dims, 0))
    a = (covariance + covariance.T) / (2 * trace)  # eigenvalues from 0 to 1
    known: dict[float, int] = {1.0 + dims * _EPS: 0}

    def count(shift: float) -> int:
        if shift not in known:
            known[shift] = above(a, shift)
        return known[shift]

    least, values, vectors = 4 * dims * _EPS, [], []
    for k in range(1, min(most, count(least)) + 1):
        seed = 0
        while True:
            lo = max(s for s, n in known.items() if n >= k)
            hi = min(s for s, n in known.items() if n < k and s > lo)
            cluster = hi - lo <= 64 * _EPS
            if cluster or (count(lo) == k and count(hi) == k - 1):
                value, vector = rayleigh(a, (lo + hi) / 2, vectors, 1000 * k + seed)
                slack = 16 * dims * _EPS
                if lo - slack <= value <= hi + slack and count(value + slack) < k <= count(value - slack) or cluster:
                    break
            seed += 1
            count((lo + hi) / 2)
        values.append(value)
        vectors.append(vector)
    order = np.argsort([-v for v in values], kind="stable")
    return np.array([values[i] for i in order]) * trace, np.stack([vectors[i] for i in order], 1) if vectors else np.zeros((dims, 0))


# ---- sums over all vectors, on Spark


def _added(parts: DataFrame, kind: type) -> dict[str, np.ndarray]:
    """`parts` (key string, v binary) by key, added up: tasks stream over the rows that hold one of a few numbers, and a second step adds
    up what these return. No task holds more than one array a key."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for key, v in zip(b["key"], b["v"]):
                x = np.frombuffer(v, kind)
                sums[key] = sums[key] + x if key in sums else x
        if sums:  # an empty frame has no kind of its own
            yield pd.DataFrame({"key": list(sums), "v": [x.tobytes() for x in sums.values()]})

    spread = F.pmod(F.xxhash64(F.col("key"), F.monotonically_increasing_id()), F.lit(32))
    some = parts.withColumn("salt", spread).repartition("key", "salt").select("key", "v").mapInPandas(add, "key string, v binary")
    all_ = some.repartition("key").mapInPandas(add, "key string, v binary")
    return {r["key"]: np.frombuffer(r["v"], kind) for r in all_.collect()}  # one row a key


def _stacked(b: pd.DataFrame, dims: int) -> np.ndarray:
    return np.stack(b["x"].to_numpy()).astype(np.int64, copy=False) if len(b) else np.zeros((0, dims), np.int64)


def sums_of(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """(n, S, largest |x|) of the vectors, as exact integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, peak = np.zeros((3, dims), np.int64), 0, 0
        for b in batches:
            x, mask = _stacked(b, dims), (1 << _LIMB) - 1
            total += np.stack([(x & mask).sum(0), (x >> _LIMB & mask).sum(0), (x >> 2 * _LIMB).sum(0)])
            n, peak = n + len(x), max(peak, -int(x.min(initial=0)), int(x.max(initial=0)))
        bits = np.zeros(64, np.int64)
        bits[peak.bit_length()] = 1  # added up, they tell the widest
        yield pd.DataFrame({"key": ["sums"], "v": [np.concatenate([[n], total.ravel(), bits]).astype(np.int64).tobytes()]})

    got = _added(fit.select("x").mapInPandas(run, "key string, v binary"), np.int64).get("sums")
    if got is None:
        return 0, [0] * dims, 0
    low, mid, high = got[1 : 1 + 3 * dims].reshape(3, dims).tolist()
    wide = np.flatnonzero(got[1 + 3 * dims :])
    return int(got[0]), [a + (b << _LIMB) + (c << 2 * _LIMB) for a, b, c in zip(low, mid, high)], (1 << int(wide.max())) - 1


class Centre:
    """Vectors less their mean S / n: the integers n x - S, exactly, and their quotients in double precision."""

    def __init__(self, n: int, sums: list[int], peak: int):
        self.n, self.sums = n, sums
        self.narrow = 2 * n * peak < 1 << 62  # n x - S fits in 64 bits
        self.short = len(sums) * (2 * n * peak) ** 2 < 1 << 63  # and so does the sum of its squares

    def whole(self, x: np.ndarray) -> np.ndarray:
        return self.n * x - np.array(self.sums, np.int64) if self.narrow else self.n * x.astype(object) - np.array(self.sums, object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.whole(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list:
        """The sum of (n x - S)² of each row; None where it is no 64-bit integer."""
        y = self.whole(x) if self.short else self.whole(x).astype(object)
        return [int(v) if v < 1 << 63 else None for v in (y * y).sum(1)]


def covariance_of(fit: DataFrame, dims: int, centre: Centre, tile: int = 512) -> np.ndarray:
    """The covariance, divisor n: products of centred vectors, in tiles of the upper triangle."""
    cuts = list(range(0, dims, tile))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {(i, j): 0.0 for i in cuts for j in cuts if i <= j}
        for b in batches:
            if len(b):
                y = centre(_stacked(b, dims))
                for i, j in sums:
                    sums[i, j] = sums[i, j] + y[:, i : i + tile].T @ y[:, j : j + tile]
        for (i, j), v in sums.items():
            if not np.isscalar(v):
                yield pd.DataFrame({"key": [f"{i} {j}"], "v": [v.tobytes()]})

    out = np.zeros((dims, dims))
    for key, v in _added(fit.select("x").mapInPandas(run, "key string, v binary"), np.float64).items():
        i, j = map(int, key.split())
        part = v.reshape(min(tile, dims - i), min(tile, dims - j)) / centre.n
        out[i : i + tile, j : j + tile] = part
        out[j : j + tile, i : i + tile] = part.T
    return out


def identity_error(fit: DataFrame, dims: int, project: Callable[[np.ndarray], np.ndarray], k: int) -> float:
    """The largest absolute entry of the covariance of the projected vectors less the identity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            w = np.concatenate([np.ones((len(b), 1)), project(_stacked(b, dims))], 1)
            total += w.T @ w
        yield pd.DataFrame({"key": ["w"], "v": [total.tobytes()]})

    got = _added(fit.select("x").mapInPandas(run, "key string, v binary"), np.float64)["w"].reshape(k + 1, k + 1)
    n, mean = got[0, 0], got[0, 1:] / got[0, 0]
    return float(np.abs(got[1:, 1:] / n - np.outer(mean, mean) - np.eye(k)).max())


# ---- the operator


def whole(embedding: str, scale: float) -> Column:
    """The array of floor(scale * c) as longs, where every entry c is there and finite and its product is a long; else null."""
    e = F.col(embedding)
    product = lambda c: c.cast("double") * F.lit(scale)
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(product(c)) < F.lit(2.0**63))
    return F.when(e.isNotNull() & (F.size(e) > 0) & F.coalesce(F.forall(e, fits), F.lit(False)), F.transform(e, lambda c: F.floor(product(c)).cast("long")))


def whiten(vectors: DataFrame, components: int = 4, scale: float = 256.0) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each vector and leading component.

    Entries become x = floor(scale * c). Fitted on each distinct x once, n of them with sums S: deviation is the sum of (n x - S)²
    (null where that is no 64-bit integer), whitened is x - S / n on the component over the root of its eigenvalue, explained the
    eigenvalue over the trace, identity_error how far the whitened fit list's covariance is from the identity. Rows are left out whose
    vector is null, empty, or has a null or non-finite entry or one beyond longs; of vectors of several lengths those of the most
    frequent one (of equally frequent ones the longest) are taken. Repeated rows and null ids are rows of their own. A covariance of
    rank r has r components at most, so equal vectors, or a single one, give no row, as an empty table does. Other columns are not read."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole("embedding", scale).alias("x")).filter("x is not null")
    points = materialize(rows, "whole-vectors")
    common = points.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], out)
    dims = common["dims"]
    points = points.filter(F.size("x") == dims)
    fit = materialize(points.select("x").distinct(), "fit-list")
    n, sums, peak = sums_of(fit, dims)
    centre = Centre(n, sums, peak)
    covariance = covariance_of(fit, dims, centre)
    values, axes = leading(covariance, components)
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], out)
    explained, axes = values / np.trace(covariance), axes / np.sqrt(values)

    def project(x: np.ndarray) -> np.ndarray:
        return centre(x) @ axes

    error = identity_error(fit, dims, project, k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _stacked(b, dims)
                yield pd.DataFrame(
                    {
                        "vec_id": b["vec_id"].astype("Int64").repeat(k).array,
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(b)),
                        "n": n,
                        "deviation": pd.array(np.repeat(np.array(centre.deviation(x), object), k), "Int64"),
                        "whitened": project(x).ravel(),
                        "explained": np.tile(explained, len(b)),
                        "identity_error": error,
                    }
                )

    return points.mapInPandas(run, out)
