"""Groups too large for one task, cut into segments; what a segment needs of the others is a row a segment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .inversions import PIECE


def largest(df: DataFrame, group: list[str]) -> int:
    """The rows of the largest group; one aggregate, of which the driver gets a number."""
    return df.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def segmented(df: DataFrame, value: str, group: list[str], most: int | None = None, piece: int = PIECE, name: str = "_segment") -> DataFrame:
    """df with `name`: the segment of its group that a row is in, numbered in the order of `value`.

    A group of at most `piece` rows is one segment; a larger one is cut at approximate quantiles of its own, into segments of about so many
    rows. Rows of one value stay together, and rows without a value are in the first segment. most: the rows of the largest group or a bound
    of them, counted where it isn't given; up to `piece` there is nothing to cut and df is not read."""
    most = largest(df, group) if most is None else most
    parts = math.ceil(most / piece)
    if parts <= 1:
        return df.withColumn(name, F.lit(0))
    at = F.percentile_approx(value, [k / parts for k in range(1, parts)], 100 * parts)
    cuts = materialize(df.groupBy(*group).agg(F.count("*").alias("_n"), at.alias("_cuts")).filter(F.col("_n") > piece).drop("_n"), "cuts")
    small = cuts.count() * parts < 1 << 20  # numbers in all
    t = df.join(F.broadcast(cuts) if small else cuts, group, "left")
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return t.withColumn(name, F.when(F.col("_cuts").isNull() | F.col(value).isNull(), 0).otherwise(below)).drop("_cuts")
