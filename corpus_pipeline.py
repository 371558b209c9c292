"""A training-data pipeline over `documents`: each stage takes what the one before kept.

Stages read their input from Parquet and return the columns of documents, the last one the packed pieces. The classifiers of the
first two stages learn from `labels` and `documents` of sf_dir (not from fold 1), and judge every document they get."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacegrid.llm import decontaminate, packing, quality, similar, toxicity
from pacegrid.llm.common import materialize


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for label 1."""
    model = quality.fit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return quality.with_score(docs, model, "__score").filter(F.col("__score") >= 0.5).drop("__score")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under 0.7."""
    model = toxicity.fit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, "__score").filter(F.col("__score") < 0.7).drop("__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash of five-word shingles, a similarity of 0.8 or more."""
    return similar.keep_one(docs, words=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item."""
    return decontaminate.clean(docs, _read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 4096 ids."""
    return packing.placed(packing.pack(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't express the classifiers, the fingerprints or the tokenizer; tests/llm/test_pipeline.py holds every stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
