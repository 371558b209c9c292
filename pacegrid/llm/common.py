"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import functools
import gc
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize, scratch  # noqa: F401


def fold(doc_id: Column | str) -> Column:
    """0, 1 or 2 by the crc32 of the id as text; 1 is held out. A null id is in fold 0."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3, F.lit(0).cast("long")).cast("int")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double")) / F.lit(float(1 << 53))


def sample_by(df: DataFrame, by: str, key: str, per_class: int, seed: int = 11) -> DataFrame:
    """About per_class rows of each value of `by`, picked by a hash of `key`, whatever the number of values."""
    known = df.filter(F.col(by).isNotNull())
    rates = known.groupBy(F.col(by).alias("__by")).agg((F.lit(float(per_class)) / F.count("*")).alias("__rate"))
    return known.join(rates, known[by] == F.col("__by")).filter(uniform(F.col(key), seed) < F.col("__rate")).drop("__by", "__rate")


def labelled(documents: DataFrame, labels: DataFrame, column: str, per_class: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(counts, rows): the number of labelled documents by label, 0 or 1; doc_id, text, label of about per_class of each, none of fold 1.
    Of several labels of a doc_id the largest counts, of several texts the smallest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(fold("doc_id") != 1)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = sample_by(known, "label", "doc_id", per_class, seed)  # two classes: broadcast below is of 2 * per_class rows or so
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return known.groupBy("label").agg(F.count("*").alias("n")), rows


def trained(rows: DataFrame, train: Callable[[pd.DataFrame], object]) -> object | None:
    """What `train` makes of all rows, a bounded sample, in a task of its own, so that the driver holds neither the sample nor what training
    takes, and a lost executor has it done again. None for an empty sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if held := [b for b in batches if len(b)]:
            yield pd.DataFrame({"model": [pickle.dumps(train(pd.concat(held, ignore_index=True)))]})

    found = rows.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(found["model"]) if found else None


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, over a task's batches, and then the memory that the worker no longer uses goes back to the system: workers outlive their tasks,
    and what a library's allocator keeps adds up with that of the workers beside it. The rows are those of `run`."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the system's library has it
                give_back(0)

    return whole


class Codes(dict):
    """Words to small integers; a word that isn't there yet gets the next one, and waits in `fresh` for its values.

    It is emptied between batches when it has grown past `most` words, so its memory is bounded whatever the corpus holds."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most, self.fresh = most, []

    def __missing__(self, word):
        code = self[word] = len(self)
        self.fresh.append(word)
        return code

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def full(self) -> bool:
        return len(self) > self.most

    def restart(self) -> None:
        self.clear()
        self.fresh = []


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i]+lengths[i]-1 of every i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)

