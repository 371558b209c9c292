"""SimHash near-duplicates: fingerprints of word shingles, joined by a binary trie under a budget of differing bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ragged
from .components import connected_components

BITS = 64


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text: A-Z lower-cased, words parted by ASCII white space, shingles of so many words with repeats,
    XXH64 with seed 42; a bit is 1 where it is set in over half the hashes. No word: zero. Fewer words: the whole sequence."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(found) - words + 1)
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    sums = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 15):
        sums += np.unpackbits(hashes[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, words: int = 3, column: str = "fp") -> DataFrame:
    """docs with a long column: the fingerprint's 64 bits."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(column, of(F.col("text")))


def trie_pairs(fps: np.ndarray, bits: list[int], budget: int, groups: np.ndarray | None = None, frontier: int = 1 << 18, meets: list[tuple[int, int]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of distinct fingerprints of one group that differ in at most `budget` of the given bits, in blocks.

    A binary trie over those bits (highest first) is held as the sorted codes: a node at depth d is a range of them. Pairs
    of nodes are walked down together, a node also with itself; a pair carries its differing bits so far, and is dropped
    once they exceed the budget. Wide frontiers are walked in parts, depth first, so memory is bounded by `frontier`.
    groups: small numbers, put before the bits, so that many tries are walked at once, each from its own root.
    meets: the pairs of groups whose tries are walked together, instead of each with itself."""
    n, depth = len(fps), len(bits)
    code = np.zeros(n, np.uint64)
    for b in bits:
        code = code << np.uint64(1) | (fps >> np.uint64(b) & np.uint64(1))
    if groups is None:
        groups = np.zeros(n, np.uint64)
    else:
        code |= groups.astype(np.uint64) << np.uint64(depth)
    order = np.argsort(code, kind="stable")
    code, groups = code[order], groups[order]
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if n else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [n]]) if n else first
    roots = np.stack([first, last, first, last, np.zeros_like(first)], 1)[last - first > 1]
    if meets is not None:
        at = {int(g): (a, b) for g, a, b in zip(groups[first], first, last)}
        roots = np.array([(*at[g], *at[k], 0) for g, k in meets if g in at and k in at], np.int64).reshape(-1, 5)
    low = np.uint64((1 << depth) - 1)
    stack = [(0, roots[k : k + frontier]) for k in range(0, len(roots), frontier)]  # ranges of the two nodes, differing bits
    while stack:
        d, pairs = stack.pop()
        if d == depth:
            yield from _leaves(pairs, order, frontier)
            continue
        single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        if single.any():  # one leaf below each: the rest of the path at once
            a, b = pairs[single, 0], pairs[single, 2]
            apart = np.bitwise_count((code[a] ^ code[b]) & low) <= budget
            keep = (a != b) & apart
            if keep.any():
                yield order[a[keep]], order[b[keep]]
            pairs = pairs[~single]
        if not len(pairs):
            continue
        bit = np.uint64(depth - 1 - d)
        mid = np.empty((len(pairs), 2), np.int64)
        for k, c in ((0, 0), (1, 2)):  # where the node's codes get this bit
            prefix = code[pairs[:, c]] >> bit | np.uint64(1)
            mid[:, k] = np.clip(np.searchsorted(code, prefix << bit), pairs[:, c], pairs[:, c + 1])
        a0, a1, b0, b1, diff = pairs.T
        same = (a0 == b0) & (a1 == b1)
        m, q = mid.T
        down = np.concatenate(
            [
                np.stack([a0, m, b0, q, diff], 1),
                np.stack([m, a1, q, b1, diff], 1),
                np.stack([a0, m, q, b1, diff + 1], 1),
                np.stack([m, a1, b0, q, diff + 1], 1)[~same],
            ]
        )
        down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= budget)]
        alone = (down[:, 0] == down[:, 2]) & (down[:, 1] - down[:, 0] == 1) & (down[:, 3] - down[:, 2] == 1)
        down = down[~alone]
        for k in range(0, len(down), frontier):
            stack.append((d + 1, down[k : k + frontier]))


def _leaves(pairs: np.ndarray, order: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs below pairs of leaves: ranges of equal codes. Large products are cut by rows of the first range."""
    a0, a1, b0, b1 = pairs[:, :4].T
    own = a0 == b0
    rows = ragged(a0, a1 - a0)  # each row of a first range meets the second, from itself on where both are one
    of = np.repeat(np.arange(len(pairs)), a1 - a0)
    start, stop = np.where(own[of], rows + 1, b0[of]), b1[of]
    ends = np.cumsum(stop - start)
    cut = np.searchsorted(ends, np.arange(most, int(ends[-1]) + most, most), side="left") + 1 if len(ends) else []
    for lo, hi in zip([0, *cut], cut):
        n = stop[lo:hi] - start[lo:hi]
        if n.sum():
            yield order[np.repeat(rows[lo:hi], n)], order[ragged(start[lo:hi], n)]


class Union:
    """Disjoint sets of 0 .. n-1; the root is the smallest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def blocks_of(bits: list[int], parts: int) -> list[list[int]]:
    """The bits in so many runs of about equal length."""
    cut = [round(k * len(bits) / parts) for k in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:])]


def block_value(fp, bits: list[int]):
    """The bits' value as a column; bits are neighbours, highest first."""
    return F.shiftrightunsigned(fp, bits[-1]).bitwiseAND(F.lit((1 << len(bits)) - 1))


def near_links(fps: DataFrame, budget: int, most: int = 20_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` at `budget` or fewer differing bits; each group of rows yields a
    forest that joins what its links join, so that components stay whole and no group writes all its pairs.

    Two fingerprints within the budget agree on one of budget + 1 blocks of bits, so the rows are dealt by (block, value)
    and a trie self-join runs on the other bits of each group. A group of more than `most` fingerprints is dealt again
    by the same rule on its remaining bits, twice at most; a group then agrees on over 45 of 64 bits, where distinct
    fingerprints are few."""
    parts = budget + 1
    if BITS < 4 * parts:
        raise ValueError(f"a budget of {budget} bits leaves blocks of under 4 of {BITS} bits; the largest is {BITS // 4 - 1} (llm/similar.py has wider fingerprints)")
    at = [("", list(range(BITS - 1, -1, -1)))]
    level = fps.select("fp").distinct().withColumn("path", F.lit(""))
    levels = []
    for depth in range(3):
        dealt, nxt = None, []
        for path, rest in at:
            if len(rest) < 4 * parts:
                nxt.append((path, rest, None))
                continue
            for k, block in enumerate(blocks_of(rest, parts)):
                nxt.append((path + chr(48 + k), [b for b in rest if b not in block], (path, block)))
        key = F.create_map(*[x for p, _, made in nxt if made for x in (F.lit(p), F.concat_ws(":", *[block_value(F.col("fp"), run).cast("string") for run in _runs(made[1])]))])
        known = "group" in level.columns
        dealt = level.select("fp", "path", *(["group"] if known else []), F.explode(F.array(*[F.lit(chr(48 + k)) for k in range(parts)])).alias("k"))
        dealt = dealt.withColumn("path", F.concat("path", "k")).drop("k")
        group = key[F.col("path")]
        dealt = dealt.withColumn("group", F.concat_ws("/", F.col("group"), group) if known else group)
        at = [(p, rest) for p, rest, made in nxt]
        if depth == 2:
            levels.append(dealt)
            break
        sizes = dealt.groupBy("path", "group").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        sizes = materialize(sizes.select("path", "group"), "large")
        if sizes.isEmpty():
            levels.append(dealt)
            break
        levels.append(dealt.join(sizes, ["path", "group"], "left_anti"))
        level = dealt.join(sizes, ["path", "group"], "left_semi")
    rest_of = dict(_rests(parts))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, rows in batch.groupby("path"):
                for some in _parts(rows["fps"].tolist(), groups=1 << BITS - len(rest_of[path])):
                    fp = np.concatenate(some).astype(np.int64).view(np.uint64)
                    group = np.repeat(np.arange(len(some)), [len(x) for x in some])
                    sets = Union(len(fp))
                    for i, j in trie_pairs(fp, rest_of[path], budget, group):
                        for a, b in zip(i.tolist(), j.tolist()):
                            sets.join(a, b)
                    up = np.array([sets.find(k) for k in range(len(fp))], np.int64)
                    moved = np.flatnonzero(up != np.arange(len(fp)))
                    yield pd.DataFrame({"a": fp[moved].view(np.int64), "b": fp[up[moved]].view(np.int64)})

    links = None
    for x in levels:
        # a group is one row, at most `most` fingerprints of eight bytes; those of one fingerprint are gone before
        rows = x.groupBy("path", "group").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1).select("path", "fps")
        made = rows.mapInPandas(join, "a long, b long")
        links = made if links is None else links.unionByName(made)
    return links


def _parts(arrays: list, most: int = 1 << 17, groups: int = 1 << 17) -> Iterator[list]:
    """The arrays in lists of about so many numbers, and of as many arrays at most as have a number beside the bits."""
    part, n = [], 0
    for x in arrays:
        part.append(np.asarray(x, np.int64))
        n += len(part[-1])
        if n >= most or len(part) >= groups:
            yield part
            part, n = [], 0
    if part:
        yield part


def _runs(bits: list[int]) -> list[list[int]]:
    """Runs of neighbouring bits."""
    out: list[list[int]] = []
    for b in bits:
        if out and out[-1][-1] == b + 1:
            out[-1].append(b)
        else:
            out.append([b])
    return out


def _rests(parts: int) -> list[tuple[str, list[int]]]:
    """For each path of blocks, the bits that its groups don't share."""
    found, at = [], [("", list(range(BITS - 1, -1, -1)))]
    for _ in range(3):
        at = [(p + chr(48 + k), [b for b in rest if b not in block]) for p, rest in at for k, block in enumerate(blocks_of(rest, parts))]
        found += at
    return found


def simhash_components(docs: DataFrame, words: int = 3, budget: int = 2, key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id reachable over links, itself included).

    One row per row of docs. Texts that are null or without words have fingerprint zero, and link like any other. Documents of
    one fingerprint are one node; a null doc_id counts as larger than any other, and a component of such rows alone has a
    null id. Columns other than the key and `text` are not read."""
    prints = materialize(with_fingerprint(docs.select(F.col(key).cast("long").alias("doc_id"), "text"), words).select("doc_id", "fp"), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(near_links(nodes, budget))
    roots = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = materialize(roots, "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    table = materialize(roots.join(least, "root").select("fp", "component_id"), "components")
    joined = prints.join(table, "fp")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """docs with one document of each group of near-duplicates: that with the smallest doc_id. Rows without a doc_id stay;
    of repeated rows of one doc_id, all stay or go."""
    found = simhash_components(docs, words, budget).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
