"""Nested feeds to typed tables, and their conforming (rows C01-C23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The shape of a contest's weekend document. A reader's declared schema is what the operators here rely on.
WEEKEND = """race_id long,
 weekend_race array<struct<race_name: string, total_miles: double, results: array<struct<driver_id: long, finish: int, start: int, status: string, car_number: string, laps_completed: long>>,
  caution_segments: array<struct<start_lap: int, end_lap: int, reason: string>>, race_leaders: array<struct<start_lap: int, end_lap: int, car_number: string>>,
  stage_results: array<struct<stage: int, results: array<struct<driver_id: long, place: int>>>>, schedule: array<struct<event_name: string, start_time: string>>>>,
 weekend_runs array<struct<run_id: long, run_type: int, results: array<struct<driver_id: long, best_lap_time: double>>>>"""
LAPS = "race_id long, laps array<struct<driver_id: long, Laps: array<struct<Lap: int, LapTime: double, RunningPos: int>>>>, flags array<struct<FlagState: int, LapsCompleted: int>>"
NOTES = "race_id long, laps map<string, array<struct<note: string, driver_ids: array<int>>>>"
LIVE = "race_id long, vehicles array<struct<number: string, driver: struct<driver_id: long, full_name: string>, laps_led: array<struct<start_lap: int, end_lap: int>>>>"


def extract_results(weekend: DataFrame) -> DataFrame:
    """C01."""
    return weekend.select("race_id", F.explode("weekend_race").alias("w")).select("race_id", F.explode("w.results").alias("r")).select("race_id", "r.*")


def extract_practice_runs(weekend: DataFrame) -> DataFrame:
    """C02. With the run's own columns."""
    return weekend.select("race_id", F.explode("weekend_runs").alias("w")).select("race_id", "w.run_id", "w.run_type", F.explode("w.results").alias("r")).select("race_id", "run_id", "run_type", "r.*")


def extract_segments(weekend: DataFrame, name: str) -> DataFrame:
    """C03, C05. Elements of an array of the first contest document, with their place."""
    first = F.try_element_at("weekend_race", F.lit(1))
    return weekend.select("race_id", F.posexplode(first[name]).alias("seq", "s")).select("race_id", "seq", "s.*")


def extract_stage_results(weekend: DataFrame) -> DataFrame:
    """C04. Contest, stage, result."""
    t = weekend.select("race_id", F.explode("weekend_race").alias("w")).select("race_id", F.explode("w.stage_results").alias("s"))
    return t.select("race_id", "s.stage", F.explode("s.results").alias("r")).select("race_id", "stage", "r.*")


def extract_race_meta(weekend: DataFrame) -> DataFrame:
    """C06. Scalars of the first element; null where the array is empty or null."""
    first = F.try_element_at("weekend_race", F.lit(1))
    return weekend.select("race_id", first["race_name"].alias("race_name"), first["total_miles"].alias("total_miles"))


def extract_laps(feed: DataFrame) -> DataFrame:
    """C07."""
    return feed.select("race_id", F.explode("laps").alias("d")).select("race_id", "d.driver_id", F.explode("d.Laps").alias("l")).select("race_id", "driver_id", F.col("l.Lap").alias("lap"), F.col("l.LapTime").alias("lap_time"), F.col("l.RunningPos").alias("running_pos"))


def extract_lap_flags(feed: DataFrame) -> DataFrame:
    """C08."""
    return feed.select("race_id", F.inline("flags")).select("race_id", F.col("LapsCompleted").alias("lap"), F.col("FlagState").alias("flag_state"))


def extract_root_array(feed: DataFrame) -> DataFrame:
    """C09, C10. feed: race_id, events (the file's root array). The order in the file is the sequence."""
    return feed.select("race_id", F.posexplode("events").alias("seq", "e")).select("race_id", "seq", "e.*")


def extract_lap_notes(feed: DataFrame) -> DataFrame:
    """C11. A map of lap to notes, both exploded; the ids stay an array."""
    return feed.select("race_id", F.explode("laps").alias("lap", "notes")).select("race_id", F.expr("try_cast(lap as int)").alias("lap"), F.explode("notes").alias("n")).select("race_id", "lap", "n.*")


def extract_live_final(feed: DataFrame) -> DataFrame:
    """C12. The nested entrant is flattened, its led ranges stay an array of structs."""
    return feed.select("race_id", F.explode("vehicles").alias("v")).select("race_id", "v.number", "v.driver.*", "v.laps_led")


def dedupe_count_conflicts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """C13. The first row of each key by `order`, with `copies` (rows equal to another one of the key in all other columns) and `conflicts` (further different rows)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    h = F.xxhash64(*rest)
    first = F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order))
    t = df.withColumn("_h", h).groupBy(*keys).agg(first.alias("_r"), (F.countDistinct("_h") - 1).alias("conflicts"), (F.count("*") - F.countDistinct("_h")).alias("copies"))
    return t.select(*keys, "_r.*", "conflicts", "copies")


def assign_seq(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """C14. 0-based order number."""
    return df.withColumn("seq", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def resolve_ids(events: DataFrame, roster: DataFrame) -> DataFrame:
    """C15. events (race_id, number, name, ...) with driver_id and how: by a number that one entrant of the contest has, else by such a name, else none."""
    num, name = F.trim("number"), F.trim("name")

    def unique(key: Column, out: str) -> DataFrame:
        g = roster.filter(key.isNotNull() & (key != "")).groupBy("race_id", key.alias("_k")).agg(F.collect_set("driver_id").alias("_s"))
        return g.filter(F.size("_s") == 1).select("race_id", F.col("_k").alias(f"_k_{out}"), F.col("_s")[0].alias(out))

    t = events.withColumns({"_k_by_number": num, "_k_by_name": name})
    t = t.join(unique(num, "by_number"), ["race_id", "_k_by_number"], "left").join(unique(name, "by_name"), ["race_id", "_k_by_name"], "left")
    how = F.when(F.col("by_number").isNotNull(), "number").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return t.withColumns({"driver_id": F.coalesce("by_number", "by_name"), "how": how}).drop("_k_by_number", "_k_by_name", "by_number", "by_name")


def first_event_time(schedule: Column, name: str) -> Column:
    """C16. Start time of the first event of that name."""
    return F.try_element_at(F.filter(schedule, lambda x: x["event_name"] == name), F.lit(1))["start_time"]


def parse_status(counts: DataFrame, results: int = 20, finishers: int = 20, laps: int = 30) -> DataFrame:
    """C17. counts (race_id, has_feed, n_results, n_finishers, n_laps) with valid and reason; the first that fails decides."""
    reason = (
        F.when(F.col("has_feed").isNull(), "not_attempted").when(~F.col("has_feed"), "no feed").when(F.col("n_results") < results, "few results")
        .when(F.col("n_finishers") < finishers, "few finishers").when(F.col("n_laps") < laps, F.format_string("usable laps=%d", "n_laps")).otherwise("ok")
    )
    return counts.withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok")


def build_races(index: DataFrame, status: DataFrame, meta: DataFrame) -> DataFrame:
    """C18. One row a contest of the index, with status and schedule facts."""
    t = index.join(status.select("race_id", "valid", "reason"), "race_id", "left").join(meta, "race_id", "left")
    return t.withColumns({"valid": F.coalesce("valid", F.lit(False)), "reason": F.coalesce("reason", F.lit("not_attempted"))})


def entity_key(name: Column) -> Column:
    """C19. The key of a name: trimmed and lower-cased, empty for null."""
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def normalise_entity(df: DataFrame, name: str) -> DataFrame:
    """C19. key, display (the most frequent spelling, ties to the first one in order) and number of contests."""
    t = df.withColumn("key", entity_key(F.col(name)))
    spelled = t.groupBy("key", name).agg(F.count("*").alias("n"))
    w = W.partitionBy("key").orderBy(F.desc("n"), name)
    display = spelled.withColumn("k", F.row_number().over(w)).filter("k = 1").select("key", F.col(name).alias("display"))
    return display.join(t.groupBy("key").agg(F.countDistinct("race_id").alias("races")), "key")


def parse_banking(text: Column) -> dict[str, Column]:
    """C20. Largest degrees and the largest labelled (tri-oval, frontstretch) ones of a free text: parts by ';', of a range its upper end."""
    parts = F.split(F.coalesce(text, F.lit("")), ";")
    degrees = lambda p: F.expr("1D") * F.array_max(F.transform(F.regexp_extract_all(p, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double")))
    labelled = lambda p: F.lower(p).rlike("tri-?oval|front ?stretch")
    top = F.array_max(F.transform(F.filter(parts, lambda p: ~labelled(p)), degrees))
    side = F.array_max(F.transform(F.filter(parts, labelled), degrees))
    return {"max_banking": top, "labelled_banking": side}


def range_join_xwalk(races: DataFrame, xwalk: DataFrame) -> DataFrame:
    """C21. races (race_id, venue, year, month) with the crosswalk row (track_id) of their name and season range. Of several, the one whose
    `months` rule fits wins; contests with more than one row left are an error; those with none are left out. The crosswalk is a short list."""
    x = xwalk.select(F.col("name").alias("_name"), "first_year", "last_year", "months", "track_id")
    on = (F.col("venue") == F.col("_name")) & F.col("year").between(F.col("first_year"), F.col("last_year"))
    t = races.join(F.broadcast(x), on)
    w = W.partitionBy("race_id")
    t = t.withColumn("_n", F.count("*").over(w)).filter((F.col("_n") == 1) | F.array_contains(F.coalesce("months", F.array().cast("array<int>")), F.col("month")))
    t = t.withColumn("_n", F.count("*").over(w))
    return t.filter(F.assert_true(F.col("_n") == 1, F.concat(F.lit("ambiguous crosswalk for contest "), F.col("race_id").cast("string"))).isNull()).drop("_n", "_name")


def assign_era(df: DataFrame, eras: DataFrame, year: str = "year") -> DataFrame:
    """C22. df with the era_key whose years hold its year; an open end is 9999."""
    e = eras.select(F.col("era_key"), F.col("start_year").alias("_s"), F.col("end_year").alias("_e"))
    return df.join(F.broadcast(e), F.col(year).between(F.col("_s"), F.col("_e"))).drop("_s", "_e")


def schedule_features(races: DataFrame, power_families: list[str], power_from: int) -> DataFrame:
    """C23. Strictly-prior facts of each contest: seasons and contests at the venue so far, seasons since the last visit (0 within a season, null at the
    debut), place in the era at the venue, whether the power rule holds."""
    past = W.partitionBy("venue").orderBy("race_seq").rowsBetween(W.unboundedPreceding, -1)
    seasons = F.size(F.collect_set("year").over(past))
    era = W.partitionBy("venue", "era_key").orderBy("race_seq")
    last = F.max("year").over(past)
    return races.select(
        "race_id", "venue", "year", (F.coalesce(F.count("*").over(past), F.lit(0)) + 1).alias("nth_at_venue"), seasons.alias("prior_seasons"),
        (F.col("year") - last).alias("seasons_since"), F.row_number().over(era).alias("nth_in_era"), (F.col("family").isin(power_families) & (F.col("year") >= power_from)).alias("power_rule"),
    )
