"""A Merkle manifest of a table whose upper proofs are made by a butterfly exchange.

Leaves are dealt to aligned blocks of fanout^k consecutive ones. A block hashes its own subtree; then blocks swap roots round by
round: in round r the blocks of an aligned group of fanout^r know the root of that group, and each sends it to one block (or, in
a last, smaller group, a few) of each other group of its run. So after its round every block has hashed the ancestor itself, redundantly with its group,
and has the siblings of that level: when the rounds end each has its whole upper proof, and nothing is sent down again. Rounds are as
many as the levels above the blocks, and a round moves fanout rows a block. Groups' roots are leaves of one more such tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

PATH = "path array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def encoded(column: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value; integers in decimal."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]).cast("binary"), 256)


# ---- places


def placed(items: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`items` with idx (place in its group by `order`, from 0) and n (size of the group). Rows that agree in all of `order` come in any
    one order. Sorted by ranges of group, order and row, so neither a large group nor very many equal rows meet in one task."""
    rows = materialize(items.withColumn("row", F.monotonically_increasing_id()), "tree-items")
    ranged = rows.repartitionByRange(group, *order, "row").sortWithinPartitions(group, *order, "row").withColumn("part", F.spark_partition_id())
    kinds = ranged.schema

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n = None, 0
        for b in batches:
            if len(b):
                key = b[group].astype(object).where(b[group].notna(), None)
                start = (key != key.shift(fill_value=last)) & ~(key.isna() & key.shift(fill_value=last).isna())
                if n == 0:
                    start.iloc[0] = True
                run = start.cumsum()
                nth = b.groupby(run.to_numpy()).cumcount() + (run == 0) * n
                last, n = key.iloc[-1], int(nth.iloc[-1]) + 1
                yield b.assign(nth=nth.astype("int64"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    ordered = materialize(ranged.mapInPandas(number, f"{fields}, nth long"), "tree-order")
    sizes = ordered.groupBy(group, "part").agg(F.count("*").alias("c"))  # a row for each range and group in it
    w = W.partitionBy(group)
    before = F.coalesce(F.sum("c").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select(F.col(group).alias("__group"), F.col("part").alias("__part"), before.alias("__before"), F.sum("c").over(w).alias("n"))
    met = ordered.join(base, ordered[group].eqNullSafe(F.col("__group")) & (F.col("part") == F.col("__part")))
    return met.withColumn("idx", F.col("__before") + F.col("nth")).drop("__group", "__part", "__before", "row", "part", "nth")


# ---- inside a block


def levels(digests: list[str], fanout: int, depth: int | None) -> list[list[str]]:
    """The nodes of a block by level, its leaves first: up to one node, or `depth` levels above the leaves if the group has more blocks."""
    out = [digests]
    while len(out[-1]) > 1 if depth is None else len(out) <= depth:
        below = out[-1]
        out.append([digest("".join(below[k : k + fanout])) for k in range(0, len(below), fanout)])
    return out


def siblings(tree: list[list[str]], k: int, fanout: int) -> list[tuple[str, str]]:
    """For leaf k of a block, level by level, the digests to the left and to the right of its run."""
    out = []
    for level in tree[:-1]:
        run = k - k % fanout
        out.append(("".join(level[run:k]), "".join(level[k + 1 : run + fanout])))
        k //= fanout
    return out


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


# ---- between blocks


def butterfly(roots: DataFrame, group: str, fanout: int, rounds: int) -> DataFrame:
    """roots (group, block, blocks, digest) with the group's root as digest and the path of each block to it."""
    state = roots.withColumn("path", F.array().cast("array<struct<left: string, right: string>>"))
    for r in range(rounds):
        size = fanout**r
        own, block, blocks = F.floor(F.col("block") / size), F.col("block"), F.col("blocks")
        first = own * size
        held = F.least(F.lit(size).cast("long"), blocks - first)  # blocks of its own aligned group
        run = F.floor(own / fanout) * fanout
        note = lambda to, mine: F.struct(to.cast("long").alias("to"), mine.alias("mine"), F.struct(own.cast("long").alias("at"), F.col("digest").alias("digest")).alias("node"))

        def others(k: int) -> Column:
            """Messages to group run + k of the run: to the block at the sender's place in it, and where the sender's group is smaller, to
            every held-th after that, so that the members share what is to be sent."""
            start = (run + k) * size + (block - first)
            end = F.least((run + k + 1) * size, blocks) - 1
            to = F.when((run + k != own) & (start <= end), F.sequence(start.cast("long"), end.cast("long"), held.cast("long")))
            return F.transform(F.coalesce(to, F.array().cast("array<long>")), lambda x: note(x, F.lit(None).cast("struct<blocks: bigint, path: array<struct<left: string, right: string>>>")))

        mine = F.struct(blocks.alias("blocks"), F.col("path").alias("path"))
        sent = state.select(group, F.explode(F.concat(F.array(note(block, mine)), *[others(k) for k in range(fanout)])).alias("m"))
        met = sent.groupBy(group, F.col("m.to").alias("block")).agg(F.first("m.mine", ignorenulls=True).alias("mine"), F.sort_array(F.collect_list("m.node")).alias("nodes"))
        at = F.floor(F.col("block") / size)
        beside = lambda keep: F.array_join(F.transform(F.filter("nodes", keep), lambda x: x["digest"]), "")
        step = F.struct(beside(lambda x: x["at"] < at).alias("left"), beside(lambda x: x["at"] > at).alias("right"))
        rising = F.col("mine.blocks") > size
        up = F.sha2(F.array_join(F.transform("nodes", lambda x: x["digest"]), "").cast("binary"), 256)
        state = met.select(
            group,
            "block",
            F.col("mine.blocks").alias("blocks"),
            F.when(rising, up).otherwise(F.col("nodes")[0]["digest"]).alias("digest"),
            F.when(rising, F.concat("mine.path", F.array(step))).otherwise(F.col("mine.path")).alias("path"),
        )
    return state


class Tree:
    """A tree a group over `items` (group, digest, and the columns of `order`): `roots` (group, root) and `blocks` (group, block, root,
    path), and the items dealt to the blocks."""

    def __init__(self, items: DataFrame, group: str, order: list[str], fanout: int, block: int):
        self.group, self.fanout = group, fanout
        self.depth = 1
        while fanout ** (self.depth + 1) <= block:
            self.depth += 1
        size = fanout**self.depth
        self.items = placed(items, group, order).withColumn("block", F.floor(F.col("idx") / size)).withColumn("blocks", F.ceil(F.col("n") / size))
        depth = self.depth

        def hashed(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("idx")
            tree = levels(pdf["digest"].tolist(), fanout, depth if pdf["blocks"].iloc[0] > 1 else None)
            return pdf.iloc[:1][[group, "block", "blocks"]].assign(digest=tree[-1][0])

        kind = items.schema[group].dataType.simpleString()
        own = self.items.select(group, "block", "blocks", "idx", "digest").groupBy(group, "block").applyInPandas(hashed, f"{group} {kind}, block long, blocks long, digest string")
        own = materialize(own, "block-roots")
        most, rounds = own.agg(F.max("blocks")).first()[0] or 1, 0
        while fanout**rounds < most:
            rounds += 1
        self.blocks = materialize(butterfly(own, group, fanout, rounds).withColumnRenamed("digest", "root"), "block-proofs")
        self.roots = self.blocks.filter("block = 0").select(group, "root")

    def proved(self, upper: DataFrame, finish, columns: list[str], schema: str) -> DataFrame:
        """What `finish(row columns, leaf path)` makes of each item's whole path: its block's own levels, then the path and root that `upper`
        (group, block, root, path) has for the block."""
        fanout, depth = self.fanout, self.depth

        def run(items: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            items = items.sort_values("idx")
            tree = levels(items["digest"].tolist(), fanout, depth if items["blocks"].iloc[0] > 1 else None)
            rest = [(s["left"], s["right"]) for s in above["path"].iloc[0]]
            return finish(items, (siblings(tree, k, fanout) + rest for k in range(len(items))), above["root"].iloc[0])

        rows = self.items.select(self.group, "block", "blocks", "idx", "digest", *columns)
        return rows.groupBy(self.group, "block").cogroup(upper.groupBy(self.group, "block")).applyInPandas(run, schema)


def manifest(docs: DataFrame, fanout: int = 2, block: int = 1024) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the Merkle proof of each row of `docs` and what becomes of it when
    some rows are tampered with.

    Leaves are hashes of doc_id, source, lang, n_chars and text, nulls told from values. Each lang (null is one of its own) has a tree over
    its leaves by doc_id (null first; rows of one doc_id by their leaf, so equal rows may swap their equal proofs); the langs' roots, null first and then by
    bytes, have one more. One is added to n_chars where 7 divides crc32(doc_id) (a null doc_id or n_chars is left as it is), and the
    root is folded anew from that leaf and the stored siblings. An empty table gives no row. Other columns are not read."""
    doc, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    fields = lambda n: leaf_of(doc, F.col("source"), F.col("lang"), n, F.col("text"))
    hit = (F.crc32(doc.cast("string").cast("binary")) % 7 == 0) & n_chars.isNotNull()
    more = (n_chars.cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    leaves = docs.select(F.col("lang").cast("string").alias("lang"), doc.alias("doc_id"), fields(n_chars).alias("digest"), F.when(hit, fields(more)).alias("tampered"))
    tree = Tree(leaves, "lang", ["doc_id", "digest"], fanout, block)
    tops = Tree(tree.roots.select(F.lit(0).alias("all"), "lang", F.col("root").alias("digest")), "all", ["lang"], fanout, block)

    def climbed(items: pd.DataFrame, paths, root: str) -> pd.DataFrame:
        paths = [[{"left": a, "right": b} for a, b in p] for p in paths]
        return pd.DataFrame({"lang": items["lang"].to_numpy(), "subroot": items["digest"].to_numpy(), "top": root, "rise": paths})

    langs = materialize(tops.proved(tops.blocks, climbed, ["lang"], "lang string, subroot string, top string, rise array<struct<left: string, right: string>>"), "lang-proofs")
    of = langs.withColumnRenamed("lang", "of")
    upper = tree.blocks.join(of, F.col("lang").eqNullSafe(F.col("of"))).select("lang", "block", F.concat("path", "rise").alias("path"), F.to_json(F.struct("subroot", "top")).alias("root"))

    def finish(items: pd.DataFrame, paths, roots: str) -> pd.DataFrame:
        import json

        ends = json.loads(roots)
        leaf, changed = items["digest"].tolist(), items["tampered"].tolist()
        proofs, ups = [], []
        for own, other, path in zip(leaf, changed, paths):
            proofs.append(digest("".join(a + b for a, b in path)))
            ups.append(folded(other if isinstance(other, str) else own, path))
        return pd.DataFrame(
            {
                "doc_id": items["doc_id"].astype("Int64").array,
                "leaf": leaf,
                "subroot": ends["subroot"],
                "root": ends["top"],
                "proof_sha256": proofs,
                "folded_root": ups,
                "verified": [x == ends["top"] for x in ups],
            }
        )

    return tree.proved(upper, finish, ["doc_id", "tampered"], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
