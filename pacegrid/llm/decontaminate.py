"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a run of words: hashes are taken of the words it keeps, so a hit survives any change of the
words it ignores. Hashes of benchmark items and of documents are joined; each hit fixes a diagonal (item, offset), along which
the overlap is verified word by word, with substitutions counted.

The masks leave no overlap of the rule out, by trial over all substitutions: items of 20 words or more have masks of five words, shorter
ones masks of three, and those of one or two words are seeds as they are."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Codes, ragged

#: Masks for items of at least so many words, the largest bound that fits.
MASKS = {20: ("11111", "110111", "111000101"), 3: ("111", "1101", "1011"), 2: ("11",), 1: ("1",)}
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall((text or "").lower())


def word_hash(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each place where the mask fits; h are word hashes."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for k in (k for k, c in enumerate(mask) if c == "1"):
        out = (out ^ h[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


class Hasher:
    """Word hashes of texts, each word hashed once."""

    def __init__(self, most: int = 800_000):
        self.codes, self.values = Codes(most), np.zeros(0, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        if self.codes.full():
            self.codes.restart()
            self.values = np.zeros(0, np.uint64)
        codes = self.codes.of(words_of(text))
        if self.codes.fresh:
            fresh, self.codes.fresh = self.codes.fresh, []
            if len(self.codes) > len(self.values):
                grown = np.zeros(max(1024, 2 * len(self.codes)), np.uint64)
                grown[: len(self.values)] = self.values
                self.values = grown
            self.values[len(self.codes) - len(fresh) : len(self.codes)] = word_hash(fresh)
        return self.values[codes]


class Seeds:
    """The hashes of a block of benchmark items, sorted by mask, with their items and places, and a bit map of their upper bits that
    most hashes of documents fail."""

    def __init__(self, items: list[tuple[int, str]], masks: dict[int, tuple[str, ...]] = MASKS):
        hashes = [word_hash(words_of(t)) for _, t in items]
        self.ids = [i for i, _ in items]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tables = []
        bounds = sorted(masks, reverse=True)
        for k, low in enumerate(bounds):
            own = [i for i, n in enumerate(self.sizes) if n >= low and (k == 0 or n < bounds[k - 1])]
            for m in masks[low] if own else ():
                made = [seed_hashes(hashes[i], m) for i in own]
                found = np.concatenate(made)
                item = np.repeat(own, [len(x) for x in made])
                place = np.concatenate([np.arange(len(x)) for x in made])
                order = np.argsort(found, kind="stable")
                there = np.zeros(1 << 20, bool)
                there[found >> np.uint64(44)] = True
                self.tables.append((m, there, found[order], item[order], place[order]))

    def diagonals(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(document, item, offset of the item in the document) of every hit, once each; documents one after the other in flat."""
        reach = int(self.sizes.max(initial=0))
        span = reach + int(sizes.max(initial=0)) + 1
        out = [np.zeros(0, np.int64)]  # the three as one number
        for m, there, hashes, item, place in self.tables:
            own = seed_hashes(flat, m)
            at = np.flatnonzero(there[own >> np.uint64(44)])
            lo, hi = np.searchsorted(hashes, own[at], "left"), np.searchsorted(hashes, own[at], "right")
            doc = np.searchsorted(starts, at, "right") - 1
            keep = (hi > lo) & (at + len(m) <= starts[doc] + sizes[doc])
            at, lo, n, doc = at[keep], lo[keep], (hi - lo)[keep], doc[keep]
            ends = np.cumsum(n)
            cut = np.searchsorted(ends, np.arange(1 << 20, int(ends[-1]) + (1 << 20), 1 << 20)) + 1 if len(n) else []
            for a, b in zip([0, *cut], cut):  # a seed that is very frequent on both sides is paired in parts
                k, times = ragged(lo[a:b], n[a:b]), n[a:b]
                offset = np.repeat((at - starts[doc])[a:b], times) - place[k]
                out.append(np.unique((np.repeat(doc[a:b], times) * len(self.ids) + item[k]) * span + offset + reach))
                if len(out) > 16:
                    out = [np.unique(np.concatenate(out))]
        found = np.unique(np.concatenate(out))
        of, offset = np.divmod(found, span)
        return np.stack([of // max(1, len(self.ids)), of % max(1, len(self.ids)), offset - reach], 1)

    def overlaps(self, docs: list[np.ndarray], share: float, rate: float, run: int, least: int) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start in the document, length, substitutions) of each verified overlap; see overlaps()."""
        sizes = np.array([len(d) for d in docs], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate([np.zeros(0, np.uint64), *docs])
        out, found = [], self.diagonals(flat, starts, sizes)
        for k in range(0, len(found), 20_000):
            doc, item, offset = found[k : k + 20_000].T
            first, last = np.maximum(0, offset), np.minimum(sizes[doc], offset + self.sizes[item])
            n = last - first
            same = flat[ragged(starts[doc] + first, n)] == self.flat[ragged(self.starts[item] + first - offset, n)]
            ends = np.cumsum(n)
            need = np.minimum(run, np.maximum(np.ceil(share * self.sizes[item] - 1e-9), whole(self.sizes[item], rate, least)))
            equal = np.add.reduceat(same, ends - n, dtype=np.int64) if len(n) else n
            for i in np.flatnonzero(equal >= need * (1 - rate) - 1e-9).tolist():
                own = same[ends[i] - n[i] : ends[i]]
                best = best_run(own, rate)
                if best and best[1] - best[0] >= need[i]:
                    out.append((int(doc[i]), int(item[i]), int(first[i]) + best[0], best[1] - best[0], int((~own[best[0] : best[1]]).sum())))
        return out


def whole(size: np.ndarray, rate: float, least: int) -> np.ndarray:
    """Words that the shortest overlap has whatever the share: `least`, of which some may be substituted at the ends; of a shorter item, all."""
    n = np.minimum(size, least)
    return n - np.floor(rate * n + 1e-9)


def best_run(same: np.ndarray, rate: float) -> tuple[int, int] | None:
    """The longest run that begins and ends with equal words and holds at most `rate` unequal ones."""
    hits = np.flatnonzero(same)
    if not len(hits):
        return None
    # for a run hits[i] .. hits[j] with j - i + 1 equal words: unequal <= rate * length  <=>  s[j] - s[i] <= 1
    count = np.arange(len(hits))
    s = (1 - rate) * hits - count
    best, least = None, []
    for j in range(len(hits)):
        if not least or s[j] > s[least[-1]]:
            least.append(j)  # starts worth trying have rising s
        # the first start i with s[i] >= s[j] - rate: unequal = length - equal
        lo, hi = 0, len(least)
        while lo < hi:
            mid = (lo + hi) // 2
            if s[least[mid]] >= s[j] - rate - 1e-9:
                hi = mid
            else:
                lo = mid + 1
        i = least[lo] if lo < len(least) else j
        if best is None or hits[j] - hits[i] > best[1] - 1 - best[0]:
            best = (int(hits[i]), int(hits[j]) + 1)
    return best


OVERLAPS = "doc_id long, item_id long, start int, n_words int, substitutions int, item_words int"


def overlaps(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, rate: float = 0.2, run: int = 13, least: int = 8, masks: dict[int, tuple[str, ...]] = MASKS, block_words: int = 2_000_000) -> DataFrame:
    """One row per document, item and diagonal with a verified overlap; places count words of the document from 0.

    An overlap is a run of words on one diagonal that begins and ends with equal words and has at most `rate` of its words
    substituted. It counts from `run` words on, and from half (`share`) of the item's words on, if that is less; yet `least`
    words must be there, less those that may be substituted, or so many of a shorter item's. An item with words put in or left out between
    has an overlap on each side, which count by the same rule.

    The benchmark is read in blocks of at most `block_words` words, each sent to the tasks as a sorted hash table; documents
    are read whole, once a block, and not shuffled. Null texts and texts without words overlap nothing; an item or a
    document that is there twice gives its rows twice, a null doc_id or item_id stays null."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in _blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            seeds, hasher = Seeds(shared.value, masks), Hasher()

            def rows(ids: list, texts: list[np.ndarray]) -> pd.DataFrame:
                made = [(ids[d], seeds.ids[k], at, n, subs, int(seeds.sizes[k])) for d, k, at, n, subs in seeds.overlaps(texts, share, rate, run, least)]
                return pd.DataFrame(made, columns=["doc_id", "item_id", "start", "n_words", "substitutions", "item_words"]).astype({"doc_id": "Int64", "item_id": "Int64"})

            for b in batches:
                ids, texts, size = [], [], 0
                for d, t in zip(b["doc_id"], b["text"]):
                    ids.append(d), texts.append(hasher(t))
                    size += len(texts[-1])
                    if size > 100_000:
                        yield rows(ids, texts)
                        ids, texts, size = [], [], 0
                yield rows(ids, texts)

        part = narrow.mapInPandas(search, OVERLAPS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], OVERLAPS)


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of so many words, read one partition after the other."""
    block, words = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        words += len(words_of(r["text"]))
        if words >= most:
            yield block
            block, words = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per document and item: the longest overlap, and how many there are."""
    found = overlaps(docs, benchmark, **how)
    best = F.max_by(F.struct("start", "n_words", "substitutions", "item_words"), F.struct("n_words", -F.col("substitutions"), -F.col("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b"), F.count("*").alias("n_overlaps")).select("doc_id", "item_id", "b.*", "n_overlaps")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the documents that overlap an item. Rows without a doc_id stay unless another such row overlaps."""
    found = overlaps(docs, benchmark, **how).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("__gone")), "left_anti")
