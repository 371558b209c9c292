"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for each node of the links (a, b), longs, the smallest node it reaches, itself included.

    Each step groups by node with a partial minimum and joins that back, so a node with very many links never meets in
    one task; each round is written to the shared folder. Links may repeat, point either way, or join a node to itself.
    An empty link table gives an empty result. It ends when a round changes nothing; log2(longest path) rounds are usual."""
    clean = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null").distinct(), "edges")
    loops = clean.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = materialize(clean.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _checksum(now)
    for _ in range(rounds):
        if state[0] == 0:
            break
        # large star: each larger neighbour of a node is linked to the node's smallest neighbour, itself included
        ways = _both_ways(now)
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = ways.join(least, F.col("a") == F.col("node")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: each smaller neighbour, and the node, is linked to the node's smallest neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
        hops = large.join(low, F.col("a") == F.col("node")).select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(hops.unionByName(low.select(F.col("node").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "links")
        state, before = _checksum(new), state
        now = new
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    out = stars.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
    return out
