"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors x, y with cosine >= c have squared distance <= 2 - 2c. Rotated by the eigenvectors of all rows' second moments and
split into m blocks of d / m coordinates, they are within (2 - 2c) / m of each other, squared, in at least one block. Each block is
range-joined under that budget: its leading coordinate (that of the largest spread) is cut into cells as wide as the
budget's root, so a pair lies in one cell or in neighbours, and the block distance is then checked. The union of the
blocks' candidates is verified by the distance over all blocks, and where that is near the bound, by the cosine of the stored components
in double precision; a pair that several blocks find counts in the first of them alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

SLACK = 1e-9


def usable() -> Column:
    """Whether a vector can link: label and vector there, no null or non-finite component, not all zero."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return F.col("label").isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False))


def second_moments(classes: DataFrame, dims: int) -> np.ndarray:
    """The sum of x xT over all unit vectors; one dims x dims matrix a task meets in the sum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for b in batches:
            x = _unit(np.stack(b["embedding"].to_numpy())) if len(b) else np.zeros((0, dims))
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(dims * dims), "v": total.ravel()})

    sums = classes.select("embedding").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(dims * dims)
    for r in sums.collect():  # dims * dims rows
        out[r["i"]] = r["v"]
    return out.reshape(dims, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no digit, so that squares neither overflow nor underflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, of stored components."""
    x, y = _scaled(x), _scaled(y)
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def rotation(moments: np.ndarray, blocks: int) -> np.ndarray:
    """Eigenvectors as columns, dealt to the blocks in turn by falling eigenvalue: block b has columns b*d/m .. , its widest first."""
    values, vectors = np.linalg.eigh(moments)
    order = np.argsort(-values)
    return vectors[:, np.concatenate([order[b::blocks] for b in range(blocks)])]


def linked(classes: DataFrame, threshold: float, blocks: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(counts, forest) of classes (cid, label, embedding, n): cid with its `links` to vectors of other classes; links (a, b) between
    classes that join what all links join. A class is all vectors of one label with equal components.

    A cell of more than `tile` vectors is cut into tiles, and each pair of tiles is a group of its own, so no task holds more than two
    tiles whatever a label or a cell holds. Groups return sums and forests, never their pairs."""
    spark = classes.sparkSession
    counts, forest = spark.createDataFrame([], "cid long, links long"), spark.createDataFrame([], "a long, b long")
    for r in classes.select(F.size("embedding").alias("s")).distinct().collect():  # vectors of different lengths never link
        of_size = classes.filter(F.size("embedding") == r["s"])
        c, f = _linked(of_size, r["s"], threshold, min(blocks, r["s"]), tile)
        counts, forest = counts.unionByName(c), forest.unionByName(f)
    return counts, forest


def _linked(classes: DataFrame, dims: int, threshold: float, blocks: int, tile: int) -> tuple[DataFrame, DataFrame]:
    turn = rotation(second_moments(classes, dims), blocks)
    sizes = [len(range(b, dims, blocks)) for b in range(blocks)]
    cut = np.concatenate([[0], np.cumsum(sizes)])
    whole = 2 - 2 * threshold + SLACK
    budget = np.array([whole * s / dims for s in sizes])
    widths = np.sqrt(budget + SLACK)
    kind = np.float32 if classes.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 2000):
                b = batch.iloc[k : k + 2000]
                x = np.stack(b["embedding"].to_numpy())
                z = _unit(x.astype(np.float64)) @ turn
                raw = [row.tobytes() for row in x.astype(kind)]
                for block in range(blocks):
                    cell = np.floor(z[:, cut[block]] / widths[block]).astype(np.int64)
                    for guest in (0, 1):  # at home in its own cell, a guest in the next
                        yield pd.DataFrame({"label": b["label"].to_numpy(), "block": block, "cell": cell + guest, "guest": guest, "cid": b["cid"].to_numpy(), "n": b["n"].to_numpy(), "x": raw})

    dealt = classes.select(F.col("label").cast("string").alias("label"), "embedding", "cid", "n").mapInPandas(deal, "label string, block int, cell long, guest int, cid long, n long, x binary")
    homes = dealt.groupBy("label", "block", "cell").agg(F.sum(F.when(F.col("guest") == 0, 1).otherwise(0)).alias("homes"), F.sum("guest").alias("guests"))
    plan = materialize(homes.filter("homes > 0 and homes + guests > 1").select("label", "block", "cell", F.ceil(F.greatest("homes", "guests") / F.lit(float(tile))).cast("int").alias("tiles")), "vector-plan")
    rows = dealt.join(plan, ["label", "block", "cell"])
    own = F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int")
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    # homes of tile i meet homes of tile j >= i, and guests of every tile j; the group (i, j, kind) has both
    meets = F.when(
        F.col("guest") == 0,
        F.concat(
            F.transform(others, lambda t: F.struct(F.least(t, own).alias("i"), F.greatest(t, own).alias("j"), F.lit(0).alias("kind"))),
            F.transform(others, lambda t: F.struct(own.alias("i"), t.alias("j"), F.lit(1).alias("kind"))),
        ),
    ).otherwise(F.transform(others, lambda t: F.struct(t.alias("i"), own.alias("j"), F.lit(1).alias("kind"))))
    # a key of its own, so that the groups of one cell are dealt to many tasks
    groups = rows.withColumn("own", own).withColumn("m", F.explode(F.when(F.col("tiles") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("kind")))).otherwise(meets)))
    groups = groups.select("block", F.xxhash64("label", "block", "cell", "m.i", "m.j", "m.kind").alias("key"), "label", "cell", "m.*", "own", "guest", "cid", "n", "x")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        block, i, j, meet = (int(pdf[c].iloc[0]) for c in ("block", "i", "j", "kind"))
        pdf = pdf.sort_values(["guest", "own", "cid"])
        left = (pdf["guest"] == 0).to_numpy() & ((pdf["own"] == i).to_numpy() | (meet == 2))
        right = (pdf["guest"] == 1).to_numpy() if meet == 1 else left if meet == 0 and i == j else (pdf["own"] == j).to_numpy() if meet == 0 else np.ones(len(pdf), bool)
        x = np.frombuffer(b"".join(pdf["x"]), kind).reshape(len(pdf), dims).astype(np.float64)
        z, n = _unit(x) @ turn, pdf["n"].to_numpy()
        squares = [(z[:, a:b] ** 2).sum(1) for a, b in zip(cut, cut[1:])]
        rows, columns, label, links = np.flatnonzero(left), np.flatnonzero(right), np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
        step = max(16, 2_000_000 // max(1, len(columns)))
        for k in range(0, len(rows), step):
            p = rows[k : k + step]
            total, ok = np.zeros((len(p), len(columns))), np.ones((len(p), len(columns)), bool)
            for b, (lo, hi) in enumerate(zip(cut, cut[1:])):
                d = squares[b][p, None] + squares[b][columns] - 2 * (z[p, lo:hi] @ z[columns, lo:hi].T)
                total += d
                if b <= block:  # the first block that finds a pair has it
                    ok &= (d <= budget[b] + SLACK) if b == block else (d > budget[b] + SLACK)
            ok &= total <= whole + SLACK
            if meet != 1:
                ok &= p[:, None] < columns  # one of the two orders; homes come before guests
            u, v = np.nonzero(ok)
            near = np.abs(total[u, v] - (2 - 2 * threshold)) < 4 * SLACK
            if near.any():
                at = np.flatnonzero(near)
                drop = at[cosines(x[p[u[at]]], x[columns[v[at]]]) < threshold]
                ok[u[drop], v[drop]] = False
                u, v = np.nonzero(ok)
            np.add.at(links, p[u], n[columns[v]])
            np.add.at(links, columns[v], n[p[u]])
            for r in np.unique(u).tolist():  # joins what is still apart: once for each pair of parts, at most
                parts = np.unique(label[columns[ok[r]]])
                parts = parts[parts != label[p[r]]]
                if len(parts):
                    merged = np.append(parts, label[p[r]])
                    label[np.isin(label, merged)] = merged.min()
        touched, cid = np.flatnonzero(links), pdf["cid"].to_numpy()
        return pd.DataFrame({"a": cid[touched], "b": cid[label[touched]], "links": links[touched]})

    found = materialize(groups.groupBy("key", "label", "block", "cell", "i", "j", "kind").applyInPandas(join, "a long, b long, links long"), "vector-links")
    return found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links")), found.filter("a <> b").select("a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, blocks: int = 4, tile: int = 8000) -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other vectors at cosine >= threshold and the same label), component_id
    (the smallest vec_id reachable by links, itself included), kept (vec_id = component_id, null-safe).

    Vectors without label, null, all zero or with a null or non-finite component link with nothing. Repeated rows, and rows of one
    vec_id or of none, are vectors of their own; a null vec_id counts as larger than any other. Labels may be of any type. Cosines
    are taken in double precision of the stored components. Other columns are not read."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    good, bad = rows.filter(usable()), rows.filter(~F.coalesce(usable(), F.lit(False)))
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    counts, forest = linked(classes, threshold, blocks, tile)
    table = materialize(connected_components(forest), "vector-components")
    reps = classes.select("cid", "least", "n").join(counts, "cid", "left").join(table, F.col("cid") == F.col("node"), "left")
    reps = materialize(reps.select("cid", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "cid").alias("root")), "vector-reps")
    of = reps.join(reps.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cid", "n_links", "component_id")
    found = good.join(classes.select("label", "embedding", "cid"), ["label", "embedding"]).join(of, "cid").select("vec_id", "n_links", "component_id")
    alone = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
