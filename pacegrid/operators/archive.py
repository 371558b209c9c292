"""Archive bookkeeping as tables: versions, coverage, increments (rows B01-B14)."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_version(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """B01. The newest row of each key, null times last; ties by the whole row."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(ts).isNotNull(), F.col(ts), F.struct(*rest)))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def coverage_grid(index: DataFrame, feeds: DataFrame, latest: DataFrame) -> DataFrame:
    """B02. Every contest of the index times every feed, with its state: stored, absent, failed, or pending. feeds is a short list."""
    grid = index.join(F.broadcast(feeds))
    t = grid.join(latest.select("race_id", "feed", "outcome"), ["race_id", "feed"], "left")
    state = F.when(F.col("outcome").isin("stored", "unchanged", "imported"), "stored").when(F.col("outcome") == "absent", "absent").when(F.col("outcome") == "failed", "failed").otherwise("pending")
    return t.withColumn("state", state).drop("outcome")


def coverage_rollup(grid: DataFrame) -> DataFrame:
    """B03. Counts by feed and state, by year and state, and by state."""
    return grid.groupingSets([["feed", "state"], ["year", "state"], ["state"]], "feed", "year", "state").agg(F.count("*").alias("n"), F.countDistinct("race_id").alias("races"))


def first_seen(grid: DataFrame) -> DataFrame:
    """B04. First year with data of each feed."""
    return grid.filter("state = 'stored'").groupBy("feed").agg(F.min("year").alias("first_year"))


def failed_cells(grid: DataFrame, most: int) -> DataFrame:
    """B05. The first failed cells in order: a report's top list."""
    return grid.filter("state = 'failed'").orderBy("race_id", "feed").limit(most)


def content_hashes(files: DataFrame) -> DataFrame:
    """path, found: the SHA-256 of each file's content, unzipped. files: path, content (as binaryFile reads it)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plain = [gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "found": [hashlib.sha256(c).hexdigest() for c in plain]})

    return files.select("path", "content").mapInPandas(run, "path string, found string")


def verify_hashes(ledger: DataFrame, found: DataFrame) -> DataFrame:
    """B06. path and state: ok, mismatched, missing (in the ledger alone) or unlisted (among the files alone)."""
    t = ledger.select("path", "sha256").join(found, "path", "full_outer")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("found") == F.col("sha256"), "ok").otherwise("mismatched")
    return t.select("path", state.alias("state"))


def detect_change(new: DataFrame, latest: DataFrame, keys: list[str]) -> DataFrame:
    """B07. new (keys, http, sha) with its outcome against the latest stored hash: failed, absent, unchanged, or stored (a new version)."""
    t = new.join(latest.select(*keys, F.col("sha").alias("_old")), keys, "left")
    outcome = F.when(F.col("http") == "failed", "failed").when(F.col("http") == "absent", "absent").when(F.col("sha").eqNullSafe(F.col("_old")), "unchanged").otherwise("stored")
    return t.withColumn("outcome", outcome).drop("_old")


def majority_valid(df: DataFrame, key: str, good: Column) -> DataFrame:
    """B08. key and valid: over half the rows are good."""
    return df.groupBy(key).agg((F.avg(F.when(good, 1.0).otherwise(0.0)) > 0.5).alias("valid"))


def has_run(winner: Column, speed: Column, time: Column) -> Column:
    """B09. There is a winner, an average speed, or a time that isn't blank."""
    return F.coalesce(winner > 0, F.lit(False)) | F.coalesce(speed > 0, F.lit(False)) | F.coalesce(F.trim(time) != "", F.lit(False))


def parse_date_lenient(s: Column) -> Column:
    """B10. An ISO time with or without Z, else the date in its first ten characters, else null."""
    t = F.try_to_timestamp(F.regexp_replace(s, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.coalesce(t, F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd")))


def refresh_candidates(index: DataFrame, feeds: DataFrame, latest: DataFrame, as_of: Column, days: int = 21) -> DataFrame:
    """B11. race_id, feed to read again: contests in the revision window, cells never stored and not known to be absent, cells that failed. A cell once."""
    cells = index.join(F.broadcast(feeds)).join(latest.select("race_id", "feed", "outcome"), ["race_id", "feed"], "left")
    recent = F.datediff(as_of, F.col("date")).between(0, days)
    missing = F.col("outcome").isNull()
    return cells.filter((recent | missing | (F.col("outcome") == "failed")) & (F.col("date") <= as_of)).select("race_id", "feed").distinct()


def build_fingerprint(hashes: DataFrame, key: str, version: str) -> DataFrame:
    """B12. A hash over the sorted feed:hash strings of a key and the logic's version."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "feed", "sha")))
    return hashes.groupBy(key).agg(F.md5(F.concat_ws("|", F.lit(version), F.concat_ws("|", parts)).cast("binary")).alias("fingerprint"))


def incremental_rebuild(state: DataFrame, before: DataFrame, old_rows: DataFrame, build: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """B13. Rows built for keys whose fingerprint moved or is new, the old rows for the others; keys that are gone fall away."""
    same = state.join(before.select(key, F.col("fingerprint").alias("_f")), key).filter(F.col("fingerprint") == F.col("_f")).select(key)
    moved = state.join(same, key, "left_anti").select(key)
    return old_rows.join(same, key, "left_semi").unionByName(build(moved))


def patch_columns(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """B14. Late columns put over the base where the patch has them."""
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    return base.join(p, key, "left").select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def rank_versions(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Version numbers of each key, newest 1."""
    return df.withColumn("version_rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(ts))))
