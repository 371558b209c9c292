"""A quality classifier: supervised subword embeddings (Joulin et al., 2016).

A document is the average of learned vectors: of its words, of their character n-grams, of their shapes and of pairs of
neighbouring shapes, each found by hashing. A softmax over that average gives the classes. It is trained by stochastic
gradient descent in numpy on a bounded sample of labelled, trained rows, and applied by a Pandas UDF: as the score is linear in the
average, each word's share is made once and looked up."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Codes, labelled, trained

BUCKETS = 1 << 16
PIECE = 1 << 18  # bytes of words whose features are made at once
_SPAN = (3, 5)  # lengths of the character n-grams
_MIX = np.uint64(0x9E3779B97F4A7C15)


_RUN = re.compile(r"(.)\1+", re.S)
_KINDS = {k: "0" if chr(k).isdigit() else ("X" if chr(k).isupper() else "x") for k in range(0x530) if chr(k).isalnum()}


def shape(word: str) -> str:
    """Xx, X, x, 0 and marks: the whole word's pattern, runs as one."""
    return _short_shape(word) if len(word) <= 64 else _RUN.sub(r"\1", word.translate(_KINDS))


@lru_cache(maxsize=200_000)
def _short_shape(word: str) -> str:
    return _RUN.sub(r"\1", word.translate(_KINDS))


def _bucket(data: bytes, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data, seed) % BUCKETS


def word_features(words: list[str], most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, word index from a on, bucket) of every feature of words a to b-1: the word, its n-grams of bytes with edges
    marked, its shape. Some words at once, of about `most` bytes; a longer word alone, in pieces that overlap by an n-gram."""
    b = 0
    while b < len(words):
        a, raw, size = b, [], 0
        while b < len(words) and (not raw or size + len(words[b]) < most):
            raw.append(b"<%b>" % words[b].encode("utf-8", "surrogatepass"))
            size, b = size + len(raw[-1]), b + 1
        owner = np.arange(b - a)
        whole = np.concatenate(
            [
                np.fromiter((_bucket(w, 1) for w in raw), np.int64, len(raw)),
                np.fromiter((_bucket(shape(w).encode("utf-8", "surrogatepass"), 2) for w in words[a:b]), np.int64, len(raw)),
            ]
        )
        if len(raw) > 1:
            where, bucket = _grams(raw)
            yield a, b, np.concatenate([owner, owner, where]), np.concatenate([whole, bucket])
            continue
        for k in range(0, size, most):
            where, bucket = _grams([raw[0][k : k + most + _SPAN[1] - 1]], most)
            yield a, b, np.zeros(len(bucket) + 2 * (k == 0), np.int64), bucket if k else np.concatenate([whole, bucket])


def _grams(raw: list[bytes], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of the n-grams of bytes; most: of those that start in so many bytes."""
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(raw)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(data))  # bytes to the end of the own word
    where, bucket = [], []
    h = np.zeros(len(data), np.uint64)
    for n in range(1, _SPAN[1] + 1):
        shifted = data if n == 1 else np.concatenate([data[n - 1 :], np.zeros(n - 1, np.uint64)])[: len(data)]
        h = (h + shifted + np.uint64(1)) * _MIX
        h = h ^ h >> np.uint64(31)
        if n >= _SPAN[0]:
            fits = left >= n
            if most is not None:
                fits[most:] = False
            where.append(owner[fits])
            bucket.append(((h[fits] >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(where), np.concatenate(bucket)


@dataclass
class Model:
    embeddings: np.ndarray  # buckets x dims
    weights: np.ndarray  # dims x 2
    bias: np.ndarray  # 2

    def margins(self) -> np.ndarray:
        """Each bucket's part of the difference between the two classes' inputs to the softmax."""
        return self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])


class Bags:
    """Documents to bags of buckets. Words, and pairs of neighbouring shapes, get their features once."""

    def __init__(self, most: int = 800_000):
        self.codes, self.pairs, self.shapes = Codes(most), Codes(most), Codes(most)
        self.restart()

    def restart(self) -> None:
        self.codes.restart(), self.pairs.restart(), self.shapes.restart()
        self.shape_of, self.size = np.zeros(0, np.int64), 0

    def full(self) -> bool:
        """By the number of words or pairs, or by the length of the words, which has no bound."""
        return self.codes.full() or self.pairs.full() or self.size > 1 << 24

    def pair_codes(self, codes: np.ndarray) -> np.ndarray:
        """A code for each pair of neighbours: their shapes, and whether the words are the same."""
        s = self.shape_of[codes]
        keys = (s[:-1] << 33 | s[1:] << 1) | (codes[:-1] == codes[1:])
        return self.pairs.of(keys.tolist())

    def words(self, text: str | None) -> np.ndarray:
        codes = self.codes.of((text or "").split())
        if len(self.codes) > len(self.shape_of):
            new = self.codes.fresh[len(self.codes.fresh) - (len(self.codes) - len(self.shape_of)) :]
            self.size += sum(map(len, new))
            self.shape_of = np.concatenate([self.shape_of, self.shapes.of([shape(w) for w in new])])
        return codes

    def pair_buckets(self, keys: list[int]) -> np.ndarray:
        names = list(self.shapes)
        return np.fromiter((_bucket(f"{names[k >> 33]} {names[k >> 1 & (1 << 32) - 1]} {k & 1}".encode("utf-8", "surrogatepass"), 3) for k in keys), np.int64, len(keys))


def train(texts: list[str], labels: np.ndarray, dims: int = 16, epochs: int = 4, rate: float = 0.5, seed: int = 7, prior: float | None = None) -> Model:
    """Softmax regression on averaged bucket vectors by mini-batch SGD with a falling rate; classes weigh the same.
    prior: the share of label 1 among all labelled rows, which the bias is moved to in the end."""
    bags, rng = Bags(1 << 62), np.random.default_rng(seed)
    coded = [bags.words(t) for t in texts]
    paired = [bags.pair_codes(c) for c in coded]
    where, bucket, many = [], [], []
    for a, b, w, found in word_features(list(bags.codes)):
        if b - a == 1:  # perhaps a piece of a long word
            found, n = np.unique(found, return_counts=True)
            w = np.zeros(len(found), np.int64)
        else:
            n = np.ones(len(found), np.int32)
        where.append(a + w), bucket.append(found), many.append(n.astype(np.int32))
    where, bucket, many = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (where, bucket, many))
    order = np.argsort(where, kind="stable")
    bucket, many, per_word = bucket[order], many[order], np.bincount(where, minlength=len(bags.codes))
    first = np.cumsum(per_word) - per_word
    pair_bucket = bags.pair_buckets(list(bags.pairs))
    docs = []
    for c, p in zip(coded, paired):
        words, times = np.unique(c, return_counts=True)
        n = per_word[words]
        spots = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[words], n)
        ids = np.concatenate([bucket[spots], pair_bucket[p]])
        weight = np.concatenate([np.repeat(times, n) * many[spots], np.ones(len(p), np.int64)])
        ids, at = np.unique(ids, return_inverse=True)
        sums = np.bincount(at, weight, len(ids))
        docs.append((ids, (sums / max(1.0, sums.sum())).astype(np.float32)))
    e = rng.normal(0, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    w, b = np.zeros((dims, 2), np.float32), np.zeros(2, np.float32)
    share = np.array([np.mean(labels == k) for k in (0, 1)])
    cost = np.where(labels == 1, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9)).astype(np.float32)
    batch, steps, done = 32, epochs * -(-len(docs) // 32), 0
    for _ in range(epochs):
        mixed = rng.permutation(len(docs))
        for k in range(0, len(docs), batch):
            some = mixed[k : k + batch]
            ids = np.concatenate([docs[i][0] for i in some])
            weight = np.concatenate([docs[i][1] for i in some])[:, None]
            own = np.repeat(np.arange(len(some)), [len(docs[i][0]) for i in some])
            vectors = e[ids] * weight
            h = np.zeros((len(some), dims), np.float32)
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            h[own[starts]] = np.add.reduceat(vectors, starts) if len(starts) else 0
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            g = p * cost[some, None]
            step = rate * (1 - done / steps)
            done += 1
            back = g @ w.T
            w -= step * h.T @ g
            b -= step * g.mean(0)
            np.subtract.at(e, ids, 10 * step * back[own] * weight)
    if prior is not None and 0 < prior < 1:
        b = b + np.array([0.0, np.log(prior / (1 - prior))], np.float32)
    return Model(e, w, b)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 1000, seed: int = 7) -> Model | None:
    """A model from about per_class labelled documents of each class at most (a documented bound: what the training
    task holds does not grow with the corpus). Rows of fold 1 are never read for it; of several labels of a doc_id the largest counts, of several
    texts the smallest. None when a class has no labelled row."""
    counts, picked = labelled(documents, labels, "quality", per_class, seed)
    totals = {r["label"]: r["n"] for r in counts.collect()}
    if len(totals) < 2:
        return None
    prior = totals[1] / (totals[0] + totals[1])

    def learn(rows: pd.DataFrame) -> Model | None:
        rows = rows.sort_values("doc_id")
        return train(rows["text"].tolist(), rows["label"].to_numpy(np.int64), seed=seed, prior=prior) if rows["label"].nunique() == 2 else None

    return trained(picked, learn)


class Scorer:
    """Scores of texts by a model, a word's share of the margin and its number of features kept."""

    def __init__(self, margins: np.ndarray, bias: float):
        self.margins, self.bias, self.bags = margins, bias, Bags()
        self.restart()

    def restart(self) -> None:
        self.bags.restart()
        self.word, self.features, self.pair = np.zeros(0), np.zeros(0), np.zeros(0)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for k in range(0, len(texts), 500):
            if self.bags.full():
                self.restart()
            some = [self.bags.words(t) for t in texts[k : k + 500]]
            pairs = [self.bags.pair_codes(c) for c in some]
            fresh, self.bags.codes.fresh = self.bags.codes.fresh, []
            if fresh:
                word, features = np.zeros(len(fresh)), np.zeros(len(fresh))
                for a, b, where, bucket in word_features(fresh):
                    word[a:b] += np.bincount(where, self.margins[bucket], b - a)
                    features[a:b] += np.bincount(where, minlength=b - a)
                self.word, self.features = np.concatenate([self.word, word]), np.concatenate([self.features, features])
            fresh, self.bags.pairs.fresh = self.bags.pairs.fresh, []
            if fresh:
                self.pair = np.concatenate([self.pair, self.margins[self.bags.pair_buckets(fresh)]])
            self.bags.shapes.fresh = []
            for i, (c, p) in enumerate(zip(some, pairs)):
                total = self.word[c].sum() + self.pair[p].sum()
                out[k + i] = total / max(1.0, self.features[c].sum() + len(p)) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def with_score(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """docs with the probability of label 1, of every whole text. A null or empty text has the bias alone; without a model
    every score is 0.5. A column of the score's name is replaced; no other column is read."""
    if model is None:
        return docs.withColumn(column, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast((model.margins(), float(model.bias[1] - model.bias[0])))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value)
        for texts in batches:
            yield pd.Series(scorer(texts.tolist()))

    return docs.withColumn(column, score(F.col("text")))
