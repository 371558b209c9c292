"""Language identification by nearest centroids.

A text is the TF-IDF vector, of length one, of its hashed byte n-grams (two and three bytes of the lower-cased letters, words
apart). Each language has several centroids, found by spherical k-means over a bounded sample of labelled texts. The
nearest centroid by cosine gives the language; a text farther from it than nearly all training texts are is marked as rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sample_by

BITS = 12
DIMS = 1 << BITS
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[a-z]")
_K = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77)]


_TABLE = bytes(c if 97 <= c < 123 or c > 127 else 32 for c in range(256))


def letters(text: str | None) -> np.ndarray:
    """The text's letters in lower case as bytes, each run of anything else in ASCII as one space; empty if there is no letter."""
    low = (text or "").lower()
    if not (_ASCII_LETTER.search(low) or any(map(str.isalpha, low))):  # numerals such as ½ ² Ⅷ are no letters
        return np.zeros(0, np.uint8)
    raw = np.frombuffer(b" %b " % low.encode("utf-8", "surrogatepass").translate(_TABLE), np.uint8)
    space = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return raw[keep]


def counts(data: np.ndarray) -> np.ndarray:
    """How often each hashed n-gram of two and three bytes is there."""
    out = np.zeros(DIMS, np.int64)
    for k in range(0, len(data), 1 << 20):  # long texts in parts that overlap by two bytes
        old = min(k, 2)
        b = data[k - old : k + (1 << 20)].astype(np.uint32)
        h2 = b[:-1] << np.uint32(8) | b[1:]
        h3 = h2[:-1] << np.uint32(8) | b[2:]
        out += np.bincount(h3 * _K[0] >> np.uint32(32 - BITS), minlength=DIMS)
        h2 = h2[max(0, old - 1) :]
        out += np.bincount(h2 * _K[1] >> np.uint32(32 - BITS), minlength=DIMS)
    return out


@dataclass
class Model:
    names: list[str]  # the language of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # of length one, one a row
    least: dict[str, float]  # a language's smallest cosine that is not rejected

    def vector(self, data: bytes) -> np.ndarray:
        v = np.log1p(counts(data).astype(np.float32)) * self.idf
        return v / max(np.sqrt(v @ v), 1e-30)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine cut to [0, 1], rejected). Without a letter: 'und', 0, rejected."""
        data = letters(text)
        if not len(data) or not self.names:
            return UNKNOWN, 0.0, True
        near = self.centroids @ self.vector(data)
        best = int(near.argmax())
        score = float(min(1.0, max(0.0, near[best])))
        return self.names[best], score, score < self.least[self.names[best]]


def train(texts: list[str], langs: list[str], clusters: int = 4, rounds: int = 12, reject: float = 0.005, seed: int = 5) -> Model:
    """reject: the share of training texts of a language that its rejection bound leaves out."""
    data = [letters(t) for t in texts]
    keep = [i for i, d in enumerate(data) if len(d)]
    tf = np.stack([np.log1p(counts(data[i])) for i in keep]).astype(np.float32) if keep else np.zeros((0, DIMS), np.float32)
    labels = np.array([langs[i] for i in keep], object)
    idf = (np.log((1 + len(keep)) / (1 + (tf > 0).sum(0))) + 0.1).astype(np.float32)
    x = tf * idf
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    names, centroids, least, rng = [], [], {}, np.random.default_rng(seed)
    for name in sorted(set(labels)):
        own = x[labels == name]
        c = own[rng.permutation(len(own))[: min(clusters, len(own))]]
        for _ in range(rounds):
            at = (own @ c.T).argmax(1)
            c = np.stack([own[at == k].mean(0) if (at == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
        names += [name] * len(c)
        centroids.append(c)
        least[name] = float(np.quantile((own @ c.T).max(1), reject))
    return Model(names, idf, np.concatenate(centroids).astype(np.float32) if centroids else np.zeros((0, DIMS)), least)


def fit(documents: DataFrame, per_language: int = 600, seed: int = 5) -> Model:
    """A model from about per_language documents of each language at most (a documented bound: the driver holds so many texts a
    language); rows of fold 1, without a text or with a null lang are never read for it."""
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("lang is not null and text is not null and doc_id is not null").filter(fold("doc_id") != 1)
    rows = sample_by(known, "lang", "doc_id", per_language, seed).toPandas().sort_values("doc_id")
    return train(rows["text"].tolist(), rows["lang"].tolist(), seed=seed)


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a struct column `language`: lang_pred, score, rejected. Reads the whole text and no other
    column; a column named language is replaced. Of centroids at one cosine the first by language name wins."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.withColumn("language", predict(F.col("text")))
