"""Discordant pairs by counting inversions: pairs are never formed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIECE = 100_000  # rows of one group that one task sorts


def inversions(values: np.ndarray, first: np.ndarray | None = None, second: np.ndarray | None = None) -> int:
    """Pairs i < j with values[i] > values[j], by merging blocks of doubling length, all blocks of a length at once. With masks, only
    pairs of an i of `first` and a j of `second`."""
    _, ranks = np.unique(values, return_inverse=True)
    n, wide, total, width = len(ranks), int(ranks.max(initial=0)) + 1, 0, 1
    at = np.arange(n)
    while width < n:
        block = at // (2 * width)
        keys = block * wide + ranks
        left = at % (2 * width) < width
        i, j = left if first is None else left & first, ~left if second is None else ~left & second
        lower = np.sort(keys[i])  # blocks one after the other, each by rank
        ends = np.searchsorted(lower, (block[j] + 1) * wide)
        total += int((ends - np.searchsorted(lower, keys[j], side="right")).sum())
        width *= 2
    return total


def _cuts(rows: DataFrame, column: str, ranges: int) -> list[float]:
    return sorted(set(rows.approxQuantile(column, [k / ranges for k in range(1, ranges)], 0.001))) if ranges > 1 else []


def _range(column: str, cuts: list[float]):
    """How many cuts are not above the value; a binary search in the expression, so rows cost log(cuts)."""

    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts)).cast("int")


def discordant(rows: DataFrame, a: str, b: str, group: list[str], ranges: int | None = None, gap: float = 0.0) -> DataFrame:
    """group, discordant: pairs of rows of a group that a and b order in opposite ways, and differ by `gap` or more in both; equal values of
    either count in no pair. Rows with a null in a or b are left out, and a group without other rows is not in the result.

    In order of a (then b) a discordant pair is an inversion of b. A group is cut into ranges of a, and into ranges of b: inversions inside
    each range of either are counted by tasks of their own, those inside both are taken off once, and those across both come from the
    counts of rows by both ranges. So a task sorts about PIECE rows, however large a group is (rows of one value stay together).
    With a gap each row stands twice, once moved by it: (a + gap, b - gap), which has to be before and above the other of the pair."""
    t = rows.select(*group, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).filter("_a is not null and _b is not null")
    both = F.lit(2).alias("_role")
    if gap > 0:
        moved = t.withColumns({"_a": F.col("_a") + gap, "_b": F.col("_b") - gap}).withColumn("_role", F.lit(0))
        t = moved.unionByName(t.withColumn("_role", F.lit(1)))
    else:
        t = t.select("*", both)
    if ranges is None:
        largest = t.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] if group else t.count()
        ranges = max(1, math.ceil((largest or 0) / PIECE))
    t = t.withColumns({"_ra": _range("_a", _cuts(t, "_a", ranges)), "_rb": _range("_b", _cuts(t, "_b", ranges))})

    def counted(keys: list[str], sign: int) -> DataFrame:
        kinds = [f"{c} {t.schema[c].dataType.simpleString()}" for c in group]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf.sort_values(["_a", "_role", "_b"])
            role = x["_role"].to_numpy()
            ranks = x["_b"].rank(method="dense").to_numpy() * 2 + (role == 0)  # a moved row counts over an equal one
            return pdf.iloc[:1][group].assign(d=sign * (inversions(ranks) if gap <= 0 else inversions(ranks, role == 0, role == 1)))

        return t.groupBy(*keys).applyInPandas(run, ", ".join([*kinds, "d long"]))

    parts = counted([*group, "_ra"], 1)
    if ranges > 1:
        parts = parts.unionByName(counted([*group, "_rb"], 1)).unionByName(counted([*group, "_ra", "_rb"], -1))
        cells = t.groupBy(*group, "_ra", "_rb").agg(F.count_if(F.col("_role") != 1).alias("c"), F.count_if(F.col("_role") != 0).alias("e"))  # at most ranges x ranges a group
        lower = cells.groupBy(*group, "_ra").agg(F.collect_list(F.struct("_rb", "c", "e")).alias("own"))
        seen = F.flatten(F.collect_list("own").over(W.partitionBy(*group).orderBy("_ra").rowsBetween(W.unboundedPreceding, -1)))
        over = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["e"] * F.aggregate(F.filter("seen", lambda y: y["_rb"] > x["_rb"]), F.lit(0).cast("long"), lambda q, y: q + y["c"]))
        parts = parts.unionByName(lower.withColumn("seen", seen).select(*group, over.alias("d")))
    return parts.groupBy(*group).agg(F.sum("d").alias("discordant"))


def pair_counts(rows: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """group, pairs, tied_a, tied_b, tied_both, discordant, concordant of the rows with both values, of groups with such a row."""
    t = rows.select(*group, F.col(a).alias("_x"), F.col(b).alias("_y")).filter("_x is not null and _y is not null")
    out = tied_pairs(t, [], group, "pairs")
    for columns, name in ((["_x"], "tied_a"), (["_y"], "tied_b"), (["_x", "_y"], "tied_both")):
        out = out.join(tied_pairs(t, columns, group, name), group)
    out = out.join(discordant(t, "_x", "_y", group), group)
    return out.withColumn("concordant", F.col("pairs") - F.col("tied_a") - F.col("tied_b") + F.col("tied_both") - F.col("discordant"))


def tied_pairs(rows: DataFrame, columns: list[str], group: list[str], name: str) -> DataFrame:
    """group, name: pairs of rows of a group that agree in all columns (none: all pairs); rows with a null there are left out."""
    there = rows
    for c in columns:
        there = there.filter(F.col(c).isNotNull())
    n = F.col("_n")
    return there.groupBy(*group, *columns).agg(F.count("*").alias("_n")).groupBy(*group).agg(F.sum(n * (n - 1) / 2).cast("long").alias(name))
