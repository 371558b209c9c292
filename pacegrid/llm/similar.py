"""SimHash near-duplicates at a similarity: wide fingerprints of word shingles, found by trie joins over blocks of bits.

Two shingle sets of Jaccard similarity s differ in a bit of their SimHash with a probability of about acos(2s / (1 + s)) / pi. The
fingerprint is made of many blocks; a pair is a candidate when some block differs in one bit at most, and there are as many
blocks as it takes for a pair at `similarity` to be missed with a probability of `missed`. Candidates are compared exactly on their shingles.

A block's rows are dealt by each of its halves, one of which agrees then, and the binary tries of the other halves are joined
under the rest of the budget. Copies of one set are one node from the start. Each group's few smallest nodes are compared with all its nodes
first; what they join needs no comparing again, so a group of near copies costs its size, not its square."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Codes, materialize, trimmed
from .components import connected_components
from .simhash import Union, trie_pairs

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ONES = np.uint64(0x0101010101010101)
_CHECK = 6  # words of the fingerprint that go with each block


class Shingler:
    """Texts to their sets of shingles, as sorted 64-bit hashes; each word is hashed once. A-Z are lower-cased and words parted by ASCII
    white space, as for the fingerprints of op3. A text of fewer words is one shingle, one without words has none."""

    def __init__(self, words: int, most: int = 200_000):
        self.words, self.codes, self.values, self.size = words, Codes(most), np.zeros(1 << 12, np.uint64), 0

    def __call__(self, text: str | None) -> np.ndarray:
        if self.codes.full() or self.size > 1 << 24:
            self.codes.restart()
            self.size = 0
        codes = self.codes.of((text or "").encode("utf-8", "surrogatepass").lower().split())
        if not len(codes):
            return np.zeros(0, np.uint64)
        if fresh := self.codes.fresh:
            self.codes.fresh = []
            self.size += sum(map(len, fresh))
            while len(self.values) < len(self.codes):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.values[len(self.codes) - len(fresh) : len(self.codes)] = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))
        h = self.values[codes]
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : i + len(out)]) * _MIX
            out ^= out >> np.uint64(31)
        return np.unique(out)


def _slices(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """The rows in frames of so many at most, so that a task holds few shingle sets at a time."""
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.iloc[k : k + rows]


def set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def wide_fingerprint(hashes: np.ndarray, longs: int) -> np.ndarray:
    """The SimHash of so many longs of a set of hashes: a bit is 1 where it is set in over half of them."""
    keys = np.random.default_rng(17).integers(1, 1 << 63, (2, longs), np.uint64) | np.uint64(1)
    counts = np.zeros((longs, 8, 8), np.int64)
    for a in range(0, len(hashes), 255 * 64):
        x = hashes[a : a + 255 * 64, None] * keys[0] + keys[1]
        x = (x ^ x >> np.uint64(32)) * _MIX
        x ^= x >> np.uint64(29)
        x = np.concatenate([x, np.zeros((-len(x) % 255, longs), np.uint64)]).reshape(-1, 255, longs)
        for k in range(8):  # 255 rows at most are added up in each byte
            counts[:, :, k] += (x >> np.uint64(k) & _ONES).sum(1).view(np.uint8).reshape(-1, longs, 8).sum(0, dtype=np.int64)
    return np.packbits(2 * counts.reshape(longs, 64) > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


@dataclass
class Layout:
    """Blocks of `width` bits (an even number), `blocks` of them, and `_CHECK` longs of which a candidate differs in `limit` bits at most."""

    width: int
    blocks: int
    limit: int

    @classmethod
    def of(cls, rows: int, similarity: float, missed: float) -> Layout:
        """Blocks as wide as the number of rows has bits, so that a row meets few others by chance however many there are."""
        q = math.acos(2 * similarity / (1 + similarity)) / math.pi
        width = max(20, 2 * math.ceil(math.log2(max(2, rows)) / 2))
        hit = (1 - q) ** width + width * q * (1 - q) ** (width - 1)
        bits = 64 * _CHECK
        return cls(width, max(1, math.ceil(math.log(missed) / math.log1p(-hit))), math.floor(bits * q + 3.5 * math.sqrt(bits * q * (1 - q))))

    @property
    def longs(self) -> int:
        return _CHECK + -(-self.width * self.blocks // 64)

    def deal(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x 2 blocks) group numbers, by block, half and the half's value, and the values of the other halves."""
        n, half = len(prints), self.width // 2
        bits = np.unpackbits(np.ascontiguousarray(prints[:, _CHECK:]).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
        value = bits[:, : self.width * self.blocks].reshape(n, 2 * self.blocks, half).astype(np.int64) @ (1 << np.arange(half, dtype=np.int64))
        group = np.arange(2 * self.blocks, dtype=np.int64) << half | value
        return group, value.reshape(n, self.blocks, 2)[:, :, ::-1].reshape(n, -1)


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs that join what the given ones join, one less than there are nodes at most."""
    names, at = np.unique(pairs, return_inverse=True)
    sets = Union(len(names))
    for i, j in at.reshape(-1, 2).tolist():
        sets.join(i, j)
    up = np.array([sets.find(k) for k in range(len(names))], np.int64)
    moved = np.flatnonzero(up != np.arange(len(names)))
    return np.stack([names[moved], names[up[moved]]], 1) if len(moved) else np.zeros((0, 2), np.int64)


def _contracted(links: DataFrame, rows: int = 200_000) -> DataFrame:
    """Links (a, b) that join what the given ones do, fewer than nodes in a task: tasks of about so many links each return a forest, with
    each node linked to the smallest of its tree. Few rounds of stars are left to do then."""
    table = materialize(links.select("a", "b"), "links")
    tasks = max(1, -(-table.count() // rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = np.zeros((0, 2), np.int64), 0
        waiting: list[np.ndarray] = []
        for b in batches:
            waiting.append(b[["a", "b"]].to_numpy(np.int64))
            n += len(b)
            if n > 2 * rows:
                held, waiting, n = _forest(np.concatenate([held, *waiting])), [], 0
        held = _forest(np.concatenate([held, *waiting]))
        yield pd.DataFrame({"a": held[:, 0], "b": held[:, 1]})

    return table.coalesce(tasks).mapInPandas(run, "a long, b long")


def _spanning(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which links (a, b) make a minimum spanning forest of them: each part takes its nearest link, until none leads out of its part."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    left, of, kept = np.lexsort((b, a, apart)), np.arange(len(names)), [np.zeros(0, np.int64)]
    sets = Union(len(names))
    while len(left):
        left = left[of[x[left]] != of[y[left]]]
        first = np.full(len(names), len(left))
        for ends in (x, y):
            np.minimum.at(first, of[ends[left]], np.arange(len(left)))
        chosen = left[np.unique(first[first < len(left)])]
        for i, j in zip(x[chosen].tolist(), y[chosen].tolist()):
            sets.join(i, j)
        kept.append(chosen)
        of = np.array([sets.find(k) for k in of.tolist()], np.int64)
    return np.concatenate(kept)


def _dealt(nodes: DataFrame, layout: Layout) -> DataFrame:
    """A row for each node and half of a block: g, node, size, component, code, c0, c1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            prints = np.frombuffer(b"".join(b["print"]), np.uint64).reshape(len(b), -1)
            g, code = layout.deal(prints)
            each = g.shape[1]
            row = {c: np.repeat(b[c].to_numpy(), each) for c in ("node", "size", "component")}
            yield pd.DataFrame({"g": g.ravel(), **row, "code": code.ravel(), **{f"c{i}": np.repeat(prints[:, i].view(np.int64), each) for i in range(_CHECK)}})

    checks = ", ".join(f"c{i} long" for i in range(_CHECK))
    return nodes.select("node", "size", "component", "print").mapInPandas(trimmed(run), f"g long, node long, size int, component long, code long, {checks}")


def _pivots(dealt: DataFrame, similarity: float, limit: int, pivots: int, turn: int) -> DataFrame:
    """Candidates (a, b) of different components between each node and a few nodes of its groups: the first one by hash in each of
    `pivots` parts. Each turn has other parts and another order."""
    part = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(pivots))
    order = F.xxhash64("node", F.lit(-1 - turn)).alias("order")
    first = dealt.groupBy("g", part.alias("part")).agg(F.min(F.struct(order, "node", "size", "component", *[f"c{i}" for i in range(_CHECK)])).alias("p")).select("g", "p")
    apart = sum((F.bit_count(F.col(f"c{i}").bitwiseXOR(F.col(f"p.c{i}"))) for i in range(_CHECK)), F.lit(0))
    fits = F.least("size", "p.size") >= F.lit(similarity) * F.greatest("size", "p.size") - 1e-9
    t = dealt.join(first, "g").filter((F.col("component") != F.col("p.component")) & (apart <= limit) & fits)
    return t.select(F.greatest("node", "p.node").alias("a"), F.least("node", "p.node").alias("b")).distinct()


def _across(dealt: DataFrame, half: int, similarity: float, limit: int, tile: int) -> DataFrame:
    """Candidates (a, b) of different components, by the trie joins of each group.

    The component of a group's smallest node is at home there, and is not joined with itself. A group of more than `tile` rows is
    cut: its home rows and its other rows into tiles of about `tile` rows each, and a task's group is one tile of each kind, or two of
    the others; a row is copied once for each tile that it meets. Of the candidates of a task's groups only a forest is returned, of
    the nearest by the check bits, that joins all nodes that they join."""
    large = materialize(dealt.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("g"), "large-groups")
    zero = F.lit(0).cast("long")
    if large.isEmpty():
        rows = dealt.select("g", zero.alias("x"), zero.alias("y"), F.lit("whole").alias("kind"), _record(F.lit(0)))
    else:
        hot = materialize(dealt.join(large, "g"), "large-rows")
        home = hot.groupBy("g").agg(F.min(F.struct("node", "component")).alias("m")).select("g", F.col("m.component").alias("home"))
        own = F.col("component") == F.col("home")
        tiles = hot.join(home, "g").groupBy("g", "home").agg(F.ceil(F.count_if(own) / tile).alias("t"), F.ceil(F.count_if(~own) / tile).alias("r")).filter("r > 0")
        cut = hot.join(tiles, "g").withColumn("m", F.explode(_meets(own))).select("g", "m.x", "m.y", "m.kind", _record(F.col("m.side")))
        small = dealt.join(large, "g", "left_anti").select("g", zero.alias("x"), zero.alias("y"), F.lit("whole").alias("kind"), _record(F.lit(0)))
        rows = small.unionByName(cut)
    columns = ["node", "component", "size", "code", *[f"c{i}" for i in range(_CHECK)], "side"]
    key = F.xxhash64("g", "x", "y").alias("key")  # of its own, so that the tiles of one group are dealt to many tasks
    sets = rows.groupBy(key, "g", "x", "y", "kind").agg(F.collect_list("r").alias("rows")).filter(F.size("rows") > 1)
    sets = sets.select("kind", *[F.col(f"rows.{c}").alias(c) for c in columns])

    def thinned(pairs: np.ndarray) -> np.ndarray:
        return pairs[_spanning(pairs[:, 0], pairs[:, 1], pairs[:, 2])]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _portions(b, 1 << 17):
                col = {c: np.concatenate(part[c].tolist()) for c in columns}
                lengths = part["node"].map(len).to_numpy()
                group = np.repeat(np.arange(len(part)), lengths)
                check = np.stack([col[f"c{i}"].view(np.uint64) for i in range(_CHECK)], 1)
                side, meets, starts = col["side"].astype(np.int64), [], np.cumsum(lengths) - lengths
                for k, (kind, at, n) in enumerate(zip(part["kind"], starts.tolist(), lengths.tolist())):
                    if kind == "whole":
                        c = col["component"][at : at + n]
                        side[at : at + n] = c == c[col["node"][at : at + n].argmin()]
                    meets += ([(2 * k, 2 * k)] if kind != "two" else []) + ([(2 * k + 1, 2 * k)] if kind != "self" else [])
                found, waiting = np.zeros((0, 3), np.int64), []
                for i, j in trie_pairs(col["code"].astype(np.uint64), list(range(half - 1, -1, -1)), 1, (2 * group + side).astype(np.uint64), meets=meets):
                    ok = col["component"][i] != col["component"][j]
                    i, j = i[ok], j[ok]
                    apart = np.bitwise_count(check[i] ^ check[j]).sum(1, dtype=np.int64)
                    x, y = col["size"][i], col["size"][j]
                    ok = (apart <= limit) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9)
                    p, q = col["node"][i[ok]], col["node"][j[ok]]
                    waiting.append(np.stack([p, q, apart[ok]], 1))
                    if sum(map(len, waiting)) > 1 << 20:
                        found, waiting = thinned(np.concatenate([found, *waiting])), []
                found = thinned(np.concatenate([found, *waiting]))[:, :2]
                yield pd.DataFrame({"a": found.max(1, initial=np.iinfo(np.int64).min), "b": found.min(1, initial=np.iinfo(np.int64).max)})

    return sets.mapInPandas(trimmed(join), "a long, b long").distinct()


def _meets(own: Column) -> Column:
    """The groups (x, y, side, kind) that a row is in, of t tiles of home rows (`own`) and r of others: each pair of a home and another
    tile, each pair of two others, and each other tile with itself."""
    t, r = F.col("t"), F.col("r")
    x, y = F.pmod(F.xxhash64("node"), t), F.pmod(F.xxhash64("node"), r)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = lambda a, b, side, kind: F.struct(a.alias("x"), b.alias("y"), F.lit(side).alias("side"), F.lit(kind).alias("kind"))
    rest = F.transform(upto(r), lambda k: F.when(k == y, place(t + k, k, 0, "self")).when(k < y, place(t + k, y, 0, "two")).otherwise(place(t + y, k, 1, "two")))
    return F.when(own, F.transform(upto(r), lambda k: place(x, k, 1, "two"))).otherwise(F.concat(F.transform(upto(t), lambda k: place(k, y, 0, "two")), rest))


def _record(side: Column) -> Column:
    return F.struct("node", "component", "size", "code", *[f"c{i}" for i in range(_CHECK)], side.alias("side")).alias("r")


def _portions(b: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """The groups of a batch in portions of about so many rows, a larger group alone."""
    lo, n = 0, 0
    for k, x in enumerate(b["node"].map(len)):
        n += x
        if n >= most:
            yield b.iloc[lo : k + 1]
            lo, n = k + 1, 0
    if lo < len(b):
        yield b.iloc[lo:]


def _sets(texts: DataFrame, wanted: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, hashes: the shingle set of each node of `wanted` (doc_id, node), once. A set is as large as its text, so sets are not shuffled to
    tell repeats: only nodes whose row stands several times in the table, which `nodes` says, are made unique after reading."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for b in _slices(batches):
            sets = [shingler(t) for t in b["text"]]
            own = [k for k, (s, n) in enumerate(zip(sets, b["node"])) if set_id(s) == n]
            yield pd.DataFrame({"node": b["node"].iloc[own], "hashes": [sets[k].tobytes() for k in own]}).drop_duplicates("node")

    found = materialize(texts.join(wanted.distinct(), "doc_id").mapInPandas(trimmed(read), "node long, hashes binary"), "sets")
    again = nodes.filter("times > 1").select("node")
    if again.isEmpty():
        return found
    return found.join(again, "node", "left_anti").unionByName(found.join(again, "node", "left_semi").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a Jaccard similarity of `similarity` or more, counted exactly."""
    pairs = materialize(pairs, "candidates")
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    wanted = nodes.join(needed, "node", "left_semi").select("node", F.col("least").alias("doc_id"))
    sets = _sets(texts, wanted, nodes, words)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k, (ha, hb) in enumerate(zip(b["ha"], b["hb"])):
                x, y = (np.frombuffer(h.as_buffer(), np.uint64) for h in (ha, hb))  # in place: the sets are most of a batch
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = shared >= similarity * (len(x) + len(y) - shared) - 1e-9
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(trimmed(compare), "a long, b long")


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of `similarity` or more: products of 0-1 matrices over the hashes that several sets have."""
    n, size = len(sets), np.array([len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(n), size), times[at] > 1
    column, owner = (np.cumsum(times > 1) - 1)[at[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner, both = column[order], owner[order], np.zeros((n, n), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [k, k + 4096])
        block = np.zeros((n, 4096), np.float32)
        block[owner[a:b], column[a:b] - k] = 1
        both += block @ block.T
    either = size[:, None] + size[None] - both.astype(np.float64)
    return both >= similarity * either - 1e-9


def _compared(edges: DataFrame, named: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, similarity: float, tile: int) -> DataFrame:
    """Links (a, b) between nodes of different components that the candidate graph joins, by comparing all of them exactly.

    The most frequent component of a part of that graph is at home there, and only others are compared with it and with each other: a
    task has two tiles of shingle sets, a set is copied once for each tile that it meets, and no pair is a row."""
    of = materialize(connected_components(_contracted(edges)).withColumnRenamed("component", "part"), "parts")
    rows = materialize(of.join(named.select("node", "component", "least"), "node"), "members")
    sizes = rows.groupBy("part", "component").agg(F.count("*").alias("n"))
    home = sizes.groupBy("part").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all"))
    tiles = home.select("part", F.col("m.component").alias("home"), F.ceil(F.col("m.n") / tile).alias("t"), F.ceil((F.col("all") - F.col("m.n")) / tile).alias("r")).filter("r > 0")
    placed = materialize(rows.join(tiles, "part").select("part", "node", "component", F.col("least").alias("doc_id"), "home", "t", "r"), "placed")

    sets = _sets(texts, placed.select("doc_id", "node"), nodes, words)
    dealt = placed.withColumn("m", F.explode(_meets(F.col("component") == F.col("home")))).select(F.xxhash64("part", "m.x", "m.y").alias("key"), "m.kind", "m.side", "node", "component")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        ok = alike([np.frombuffer(x, np.uint64) for x in pdf["hashes"]], similarity)
        component, side, node = (pdf[c].to_numpy() for c in ("component", "side", "node"))
        ok &= component[:, None] != component
        if pdf["kind"].iloc[0] == "two":
            ok &= side[:, None] != side
        pairs = _forest(np.stack(np.nonzero(np.triu(ok)), 1))
        return pd.DataFrame({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]}).astype("int64")

    return dealt.join(sets, "node").groupBy("key", "kind").applyInPandas(compare, "a long, b long")


def _merged(named: DataFrame, links: DataFrame) -> DataFrame:
    """`named` with each component that the links (a, b) join named by the smallest of them: the links are followed from component to
    component, so what earlier links joined is not followed again."""
    at = lambda end: named.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    ends = links.join(at("a"), "a").join(at("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    of = connected_components(_contracted(ends)).filter("node <> component").select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return named.join(materialize(of, "components"), "component", "left").withColumn("component", F.coalesce("joined", "component")).drop("joined")


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, missed: float = 0.01, pivots: int = 4, turns: int = 1, tile: int = 4096) -> DataFrame:
    """doc_id, stays: for each row with a doc_id, the smallest doc_id of its group. Links join texts whose sets of `words`-word shingles
    have a Jaccard similarity of `similarity` or more; texts without words are one group. missed: the chance that a pair at exactly
    `similarity` is no candidate; nearer pairs are missed far less. Only doc_id and text are read."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    layout = Layout.of(docs.count(), similarity, missed)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for b in _slices(batches):
            sets = [shingler(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "node": [set_id(s) for s in sets], "size": [len(s) for s in sets], "print": [wide_fingerprint(s, layout.longs).tobytes() for s in sets]})

    signs = materialize(texts.mapInPandas(trimmed(sign), "doc_id long, node long, size int, print binary"), "signs")
    # rows of a node's smallest doc_id: a row counts as repeated where several of one doc_id have one set
    often = signs.groupBy("node", "doc_id").agg(F.count("*").alias("times")).filter("times > 1").select("node", F.col("doc_id").alias("least"), "times")
    nodes = signs.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("print").alias("print"))
    nodes = materialize(nodes.join(often, ["node", "least"], "left").withColumn("times", F.coalesce("times", F.lit(1).cast("long"))), "nodes")
    named = nodes.withColumn("component", F.col("node"))
    few = Layout(layout.width, min(6, layout.blocks), layout.limit)  # enough to join most of a large group; the rest is found across
    for turn in range(turns):
        near = _pivots(_dealt(named.filter("size > 0"), few), similarity, layout.limit, pivots, turn)
        named = _merged(named, materialize(_verified(near, texts, nodes, words, similarity), "links"))
    edges = _across(_dealt(named.filter("size > 0"), layout), layout.width // 2, similarity, layout.limit, tile)
    named = _merged(named, materialize(_compared(edges, named, texts, nodes, words, similarity, min(tile, 256)), "links"))
    roots = materialize(named.select("node", "least", F.col("component").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("stays"))
    return signs.select("doc_id", "node").join(roots.join(least, "root").select("node", "stays"), "node").select("doc_id", "stays")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, **how) -> DataFrame:
    """docs with one document of each group of near copies: that with the smallest doc_id. Rows without a doc_id stay and link
    nothing; of repeated rows of one doc_id, all stay or go. Columns are those of docs, whatever their names."""
    gone = similar_components(docs, words, similarity, **how).filter("doc_id <> stays").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
