"""Reading, writing and combining tables (rows S01-S16)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import scratch  # noqa: F401

LEDGER = T.StructType([T.StructField(n, t) for n, t in (("feed", T.StringType()), ("series", T.IntegerType()), ("year", T.IntegerType()), ("race_id", T.LongType()), ("path", T.StringType()), ("fetched_at", T.TimestampType()), ("outcome", T.StringType()), ("sha256", T.StringType()), ("bytes", T.LongType()))])


def read_fetch_log(spark: SparkSession, path: str) -> DataFrame:
    """S01. The ledger, newline-delimited JSON under a declared schema; a missing or empty file gives an empty table of that schema."""
    try:
        return spark.read.schema(LEDGER).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def path_keys(path: Column) -> dict[str, Column]:
    """S02. series, year, race_id, feed and version of an archive path, in its three layouts: series_1/2024/5618/feed/20240101T000000.json.gz,
    series_1/2024/5618/feed.json.gz (version null) and index/2024/20240101T000000.json.gz (no contest; feed 'index')."""
    full = r"series_(\d+)/(\d{4})/(\d+)/([a-z_-]+)/(\d{8}T\d{6})\.json"
    plain = r"series_(\d+)/(\d{4})/(\d+)/([a-z_-]+)\.json"
    index = r"index/(\d{4})/(\d{8}T\d{6})\.json"
    got = lambda pattern, k: F.nullif(F.regexp_extract(path, pattern, k), F.lit(""))
    return {
        "series": F.coalesce(got(full, 1), got(plain, 1)).cast("int"),
        "year": F.coalesce(got(full, 2), got(plain, 2), got(index, 1)).cast("int"),
        "race_id": F.coalesce(got(full, 3), got(plain, 3)).cast("long"),
        "feed": F.coalesce(got(full, 4), got(plain, 4), F.when(path.rlike(index), "index")),
        "version": F.coalesce(got(full, 5), got(index, 2)),
    }


def archive_files(spark: SparkSession, root: str) -> DataFrame:
    """S02. One row a file under root, its keys from its path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return files.withColumns(path_keys(F.col("path")))


def newest_ledger_row(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """S02, last part: files with the newest ledger row of their path."""
    newest = ledger.groupBy("path").agg(F.max_by(F.struct("outcome", "sha256", "fetched_at"), F.struct(F.col("fetched_at").isNotNull(), "fetched_at")).alias("l")).select("path", "l.*")
    return files.join(newest, "path", "left")


def read_nested(spark: SparkSession, schema: T.StructType, *paths: str) -> DataFrame:
    """S03. Whole-file JSON under a declared schema: missing keys are null, types can't drift between files, broken files keep their text in _corrupt_record."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("multiLine", True).option("mode", "PERMISSIVE").json(list(paths))


def race_index_latest(snapshots: DataFrame) -> DataFrame:
    """S04. snapshots: year, fetched_at, series_1, series_2, series_3 (arrays of struct<race_id, season, ...>). The newest valid snapshot of each year, a row a
    contest; a snapshot is valid when over half its contests carry its year, or it is empty."""
    names = [c for c in snapshots.columns if c.startswith("series_")]

    def tagged(c: str) -> Column:
        return F.transform(F.coalesce(c, F.array().cast(snapshots.schema[c].dataType)), lambda x: F.struct(F.lit(int(c[7:])).alias("series"), x.alias("r")))

    rows = F.concat(*map(tagged, names))
    t = snapshots.withColumn("rows", rows)
    hits = F.size(F.filter("rows", lambda x: x["r"]["season"] == F.col("year")))
    valid = t.filter((F.size("rows") == 0) | (2 * hits > F.size("rows")))
    newest = valid.groupBy("year").agg(F.max_by("rows", "fetched_at").alias("rows"))
    return newest.select("year", F.explode("rows").alias("x")).select("year", "x.series", "x.r.*")


def fallback_union(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """S05. The rows of primary, and those of fallback for keys that primary has none of."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti"))


def trim_index(index: DataFrame, texts: list[str], keep: list[str], done: Column) -> DataFrame:
    """S06. The kept columns, blank texts as null, and the completion flag."""
    return index.select(*keep, *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in texts], F.coalesce(done, F.lit(False)).alias("has_run"))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df cast to a declared schema, columns in its order; a column that isn't there is null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_table(df: DataFrame, path: str, schema: T.StructType, partition: str | None = None) -> None:
    """S07. Parquet under a declared schema. With a partition column, only the partitions that df has are replaced."""
    w = conform(df, schema).write.mode("overwrite")
    (w.option("partitionOverwriteMode", "dynamic").partitionBy(partition) if partition else w).parquet(path)


def register_layer(spark: SparkSession, layer: str, paths: dict[str, str]) -> list[str]:
    """S08. A temporary view layer_name for each Parquet table that is there; returns their names."""
    made = []
    for name, path in paths.items():
        try:
            spark.read.parquet(path).createOrReplaceTempView(f"{layer}_{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        made.append(f"{layer}_{name}")
    return made


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S09. CSV with a header and declared types. Booleans may be written True or true."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(texts).option("header", True).csv(path)

    def typed(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.BooleanType):
            return F.lower(F.trim(f.name)) == "true"
        return F.expr(f"try_cast(nullif(trim(`{f.name}`), '') as {f.dataType.simpleString()})")

    return raw.select(*[typed(f).alias(f.name) for f in schema.fields])


def read_json_union(spark: SparkSession, schema: T.StructType, *paths: str) -> DataFrame:
    """S10. JSON files of differing keys under one schema that has them all."""
    return spark.read.schema(schema).option("multiLine", True).json(list(paths))


def seed_dim(df: DataFrame, key: str, mapping: dict[str, str], name: str, default: str = "UNIQ") -> DataFrame:
    """S11. df with a literal lookup; keys it hasn't read as the default. The literal is small by nature and goes to every task."""
    seed = df.sparkSession.createDataFrame(sorted(mapping.items()), f"{key} string, {name} string")
    return df.join(F.broadcast(seed), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def unpivot_scores(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """S12. A row per id and score column."""
    return df.unpivot(ids, columns, "name", "score")


def widen_union(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """S13. One row a key over the union of the frames' keys, a column a frame: in long form, then pivoted, so the number of shuffles is two whatever the number of frames."""
    long = None
    for name, f in frames.items():
        part = f.select(*keys, F.lit(name).alias("_m"), F.col("value").cast("double").alias("_v"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy(*keys).pivot("_m", list(frames)).agg(F.first("_v"))


def append_log(df: DataFrame, path: str) -> None:
    """S14."""
    df.write.mode("append").parquet(path)


def upsert_log(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """S15. Rows of new replace those of old with the same key; doing it again changes nothing."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def dim_with_provenance(df: DataFrame, source_hash: Column, version: str, built_at: str) -> DataFrame:
    """S16. df with the source's hash, the package version and the build stamp on each row."""
    return df.withColumns({"source_sha256": source_hash, "package_version": F.lit(version), "built_at": F.lit(built_at)})
