"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs to the letters they look like and digits or marks inside words to the letters they
stand for, and puts one space between words. The lexicon is learned from labelled rows: whole words, and beginnings of words,
that toxic rows have far more often than others; words around a match that only clean rows have make exception phrases."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, trained

#: Letters of other scripts by the Latin letter they look like, and digits by the letter they stand for.
LOOKALIKES = {
    "a": "аɑα＠ａ", "b": "ьЬｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еєｅ", "f": "ｆ", "g": "ɡｇ", "h": "һｈ", "i": "іıɩｉ", "j": "јｊ", "k": "κкｋ", "l": "ӏⅼｌ", "m": "мｍ",
    "n": "ոｎ", "o": "оοօｏ", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ", "t": "тτｔ", "u": "υսｕ", "v": "νѵｖ", "w": "ԝｗ", "x": "хχｘ", "y": "уүｙ", "z": "ｚ",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
MARKS = {"@": "a", "$": "s", "!": "i"}
_FOLD = str.maketrans({c: k for k, cs in LOOKALIKES.items() for c in cs} | DIGITS | {c: "" for c in "​‌‍­﻿"})
_INNER = re.compile(r"[@$](?=[^\W\d_])|(?<=[^\W\d_])!(?=[^\W\d_])")
_OTHER = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """The folded text, a space before and after each word."""
    text = (text or "").lower()
    if "@" in text or "$" in text or "!" in text:
        text = _INNER.sub(lambda m: MARKS[m[0]], text)
    return f" {_OTHER.sub(' ', text.translate(_FOLD)).strip()} "


@dataclass
class Model:
    lexicon: dict[str, float]  # folded words (' word ') and beginnings of words (' begi') with their weights
    exceptions: list[str] = field(default_factory=list)  # folded phrases in which a match doesn't count
    curve: tuple[float, float, float] = (0.0, 1.0, 1.0)  # bias, weight of the sum, weight of the sum by length


class Matcher:
    def __init__(self, model: Model):
        self.curve, self.weights = model.curve, model.lexicon
        self.automaton = ahocorasick.Automaton()
        for k in [*model.lexicon, *model.exceptions]:
            self.automaton.add_word(k, k)
        self.exceptions = frozenset(model.exceptions)
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, str]]:
        """(start, entry) in a folded text: of the entries that begin at a place, the longest, and none in an exception."""
        if not len(self.automaton):
            return []
        at: dict[int, str] = {}
        spared = []
        for end, key in self.automaton.iter(text):
            start = end - len(key) + 1
            if key in self.exceptions:
                spared.append((start, end))
            elif len(key) > len(at.get(start, "")):
                at[start] = key
        # a match is in an exception if, of those that begin no later, the one that reaches farthest reaches its end
        spared.sort()
        starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        return [(s, k) for s, k in at.items() if not ((i := bisect_right(starts, s)) and s + len(k.rstrip()) <= reach[i - 1] + 1)]

    def features(self, text: str | None) -> tuple[float, float]:
        """The weights of the matches in all, and by length (a hundred words)."""
        text = folded(text)
        total = sum(self.weights[k] for _, k in self.found(text))
        return np.log1p(total), np.log1p(100 * total / max(1, text.count(" ") - 1)) if total else 0.0

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -40, 40))))


def candidates(text: str, shortest: int = 4, longest: int = 9) -> set[str]:
    words = set(text.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in range(shortest, min(longest, len(w)) + 1)}


def unlike(texts: list[str], words: int = 8, most: float = 0.3) -> list[int]:
    """The texts of which at most that share of word runs was there in texts before. Copies of a text count as one, else all its words
    would seem to go with its label."""
    seen: set[int] = set()
    keep = []
    for i, t in enumerate(texts):
        w = t.split()
        runs = {hash(tuple(w[k : k + words])) for k in range(max(1, len(w) - words + 1))}
        if len(runs & seen) <= most * len(runs):
            keep.append(i)
        seen |= runs
    return keep


def evidence(bad: int, good: int, share: float) -> float:
    """Log-likelihood ratio of an entry's toxic rows against the sample's share of toxic rows; it grows with the rows that have the entry."""
    n = bad + good
    return bad * np.log(bad / (n * share)) + (good * np.log(good / (n * (1 - share))) if good else 0.0)


def train(texts: list[str], toxic: np.ndarray, least: int = 4, odds: float = 20.0, sure: float = 10.0, exceptions: tuple[str, ...] = ()) -> Model:
    """least: toxic rows that must have an entry. odds: how much larger its share of toxic rows must be than that of the others. sure: the
    evidence it needs, as among very many rare words some are in a few toxic rows by chance."""
    keep = unlike([folded(t) for t in texts])
    texts, toxic = [texts[i] for i in keep], toxic[keep]
    plain = [folded(t) for t in texts]
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    # a first count by hash: only what shares a bucket with `least` rows is counted by name, as most words are rare
    buckets = np.zeros(1 << 23, np.uint16)
    place = lambda t: np.fromiter({hash(k) & len(buckets) - 1 for k in candidates(t)}, np.int64)
    for t, y in zip(plain, toxic):
        if y:
            buckets[place(t)] += 1
    bad, good = Counter(), Counter()
    for t, y in zip(plain, toxic):
        if y:
            bad.update(k for k in candidates(t) if buckets[hash(k) & len(buckets) - 1] >= least)
    wanted = {k for k, n in bad.items() if n >= least}
    for t, y in zip(plain, toxic):
        if not y:
            good.update(candidates(t) & wanted)
    ratio = {k: (bad[k] + 0.1) / n_toxic / ((good[k] + 0.5) / n_clean) for k in wanted}
    share = n_toxic / (n_toxic + n_clean)
    chosen: dict[str, float] = {}
    for k in sorted((k for k in wanted if ratio[k] >= odds and evidence(bad[k], good[k], share) >= sure), key=lambda k: (-bad[k], len(k), k)):
        if not any(k != p and k.startswith(p) for p in (k[:n] for n in range(4, len(k))) if p in chosen and good[p] <= good[k] + 0.02 * bad[p]):
            chosen[k] = float(np.log(ratio[k]))
    model = Model(chosen, [folded(x) for x in exceptions])
    # neighbours of a match that only clean rows show, twice at least, are exceptions
    matcher, around = Matcher(model), {0: Counter(), 1: Counter()}
    for t, y in zip(plain, toxic):
        seen = set()
        for s, _ in matcher.found(t):
            end = t.find(" ", s + 1)
            after = t.find(" ", end + 1)
            before = t.rfind(" ", 0, s)
            seen |= {t[s : after + 1]} if after > 0 else set()
            seen |= {t[before : end + 1]} if before >= 0 else set()
        around[int(y > 0)].update(seen)
    model.exceptions += sorted(k for k, n in around[0].items() if n >= 2 and not around[1][k])
    matcher = Matcher(model)
    x = np.array([(1.0, *matcher.features(t)) for t in texts])
    y = (toxic > 0).astype(float)
    w = np.zeros(3)
    for _ in range(60):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + 0.05 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w -= np.linalg.solve(h, g)
    model.curve = tuple(w)
    return model


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 2000, seed: int = 9, exceptions: tuple[str, ...] = ()) -> Model:
    """A model from about per_class labelled documents of each class at most (a documented bound). Rows of fold 1 are never
    read for it; of several labels of a doc_id the largest counts, of several texts the smallest. Without labelled rows the lexicon is empty."""

    def learn(rows: pd.DataFrame) -> Model | None:
        rows = rows.sort_values("doc_id")
        return train(rows["text"].tolist(), rows["label"].to_numpy(np.int64), exceptions=exceptions) if rows["label"].nunique() == 2 else None

    model = trained(labelled(documents, labels, "toxic", per_class, seed)[1], learn)
    return model or Model({}, [folded(x) for x in exceptions], (-3.0, 1.0, 1.0))


def with_score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a toxicity from 0 to 1, of every whole text; a null or empty text scores as one without a match. A column of
    the score's name is replaced; no other column is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value)
        for texts in batches:
            yield pd.Series([matcher.score(t) for t in texts], dtype="float64")

    return docs.withColumn(column, score(F.col("text")))
