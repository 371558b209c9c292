"""Data-quality checks on tables: each returns the rows that break a rule, or a verdict a key (rows Q01-Q20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.inversions import discordant, pair_counts
from ..sources.shared import materialize


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], group: str, tolerant: dict[str, float] | None = None) -> DataFrame:
    """Q01. Cell by cell: per group the cells compared, exact ones, those within tolerance alone, and the verdict pass, pass-with-note or fail.

    Nulls equal nulls, blank texts equal null; a row that one side lacks fails with all its cells. tolerant: a column's largest difference, relative to the
    larger of 1 and its absolute value."""
    tolerant = tolerant or {}
    columns = [c for c in a.columns if c not in keys]
    x = a.select(*keys, F.struct(*columns).alias("_x"))
    y = b.select(*keys, F.struct(*columns).alias("_y"))
    t = x.join(y, keys, "full_outer")
    types = dict(a.dtypes)

    def cell(side: str, c: str) -> Column:
        v = F.col(side)[c]
        return F.nullif(F.trim(v), F.lit("")) if types[c] == "string" else v

    exact, near = [], []
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    for c in columns:
        p, q = cell("_x", c), cell("_y", c)
        same = both & p.eqNullSafe(q)
        exact.append(F.when(same, 1).otherwise(0))
        close = both & F.coalesce(F.abs(p - q) <= tolerant[c] * F.greatest(F.lit(1.0), F.abs(p)), F.lit(False)) if c in tolerant else F.lit(False)
        near.append(F.when(~same & close, 1).otherwise(0))
    add = lambda xs: sum(xs, F.lit(0))
    g = t.groupBy(group).agg((F.count("*") * len(columns)).alias("cells"), F.sum(add(exact)).alias("exact"), F.sum(add(near)).alias("within"))
    verdict = F.when(F.col("exact") == F.col("cells"), "pass").when(F.col("exact") + F.col("within") == F.col("cells"), "pass-with-note").otherwise("fail")
    return g.withColumn("verdict", verdict)


def unexpected_rows(table: DataFrame, anchor: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """Q02. Keys of the table inside the range that the anchor lacks."""
    return table.filter(inside).select(*keys).distinct().join(anchor, keys, "left_anti")


def feature_parity(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tol: float = 1e-9) -> DataFrame:
    """Q03. Mismatching cells: key membership, null pattern, or relative difference over tol."""
    t = a.select(*keys, F.struct(*columns).alias("_x")).join(b.select(*keys, F.struct(*columns).alias("_y")), keys, "full_outer")
    one = F.col("_x").isNull() | F.col("_y").isNull()
    rows = []
    for c in columns:
        p, q = F.col("_x")[c].cast("double"), F.col("_y")[c].cast("double")
        kind = F.when(one, "membership").when(p.isNull() != q.isNull(), "null").when(F.abs(p - q) > tol * F.greatest(F.lit(1.0), F.abs(p)), "value")
        rows.append(F.struct(F.lit(c).alias("column"), kind.alias("kind")))
    return t.select(*keys, F.explode(F.array(*rows)).alias("m")).select(*keys, "m.*").filter("kind is not null")


def discordant_pairs(scores: DataFrame, group: str, a: str, b: str, tol: float = 1e-7) -> DataFrame:
    """Q04. Per group of two rows or more: its pairs, those that two scores order differently (a tie of one alone is such a pair), and those of them that are
    near ties, under tol apart in either. By counts of inversions and ties; no pair is formed. Rows without either score are left out."""
    t = materialize(scores.select(group, F.col(a).cast("double").alias("_x"), F.col(b).cast("double").alias("_y")), "scores")
    far = discordant(t, "_x", "_y", [group], gap=tol).withColumnRenamed("discordant", "_far")
    off = F.col("pairs") - F.col("concordant") - F.col("tied_both")
    c = pair_counts(t, "_x", "_y", [group]).filter("pairs > 0").join(far, group)
    return c.select(group, "pairs", off.alias("discordant"), (off - F.col("_far")).alias("near_ties"))


def one_winner(df: DataFrame, group: str, rank: str) -> DataFrame:
    """Q05. Groups whose count of rank 1 is not 1."""
    return df.groupBy(group).agg(F.count_if(F.col(rank) == 1).alias("winners")).filter("winners <> 1")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q06."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def ref_integrity(fact: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """Q07. Keys that only one side has."""
    f, d = fact.select(*keys).distinct(), dim.select(*keys).distinct()
    return f.join(d, keys, "left_anti").withColumn("missing_in", F.lit("dimension")).unionByName(d.join(f, keys, "left_anti").withColumn("missing_in", F.lit("fact")))


def floor_rule(profiles: DataFrame, n: str, value: str, pool: str, floor: int) -> DataFrame:
    """Q08. Rows under the floor whose value isn't the family's, and values without anything behind them."""
    under = (F.col(n) < floor) & ~F.col(value).eqNullSafe(F.col(pool))
    return profiles.filter(under | (F.col(pool).isNull() & F.col(value).isNotNull()))


def null_rule(values: DataFrame, evidence: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Q09. Rows that are null though there is evidence, or the other way round."""
    t = values.join(evidence.select(*keys).distinct().withColumn("_e", F.lit(True)), keys, "left")
    return t.filter(F.col(value).isNotNull() != F.coalesce("_e", F.lit(False))).drop("_e")


def interval_tiling(intervals: DataFrame, key: str, start: str, end: str, open_end: int = 9999) -> DataFrame:
    """Q10. Intervals that the next one doesn't follow directly; the last one must be open."""
    nxt = F.lead(start).over(W.partitionBy(key).orderBy(start))
    return intervals.withColumn("_n", nxt).filter(F.when(F.col("_n").isNull(), F.col(end) != open_end).otherwise(F.col("_n") != F.col(end) + 1)).drop("_n")


def complete_cross(ids: DataFrame, names: DataFrame, table: DataFrame, low: float = 1, high: float = 10) -> DataFrame:
    """Q11. (id, name) that the table (id, name, score) lacks, or whose score is out of range. names is a short list."""
    want = ids.join(F.broadcast(names))
    gone = want.join(table, ["id", "name"], "left_anti").withColumn("fault", F.lit("missing"))
    out = table.filter(~F.col("score").between(low, high)).select("id", "name").withColumn("fault", F.lit("range"))
    return gone.select("id", "name", "fault").unionByName(out)


def prob_coherence(wins: DataFrame, makes: DataFrame, tops: DataFrame, names: list[str], tol: float = 1e-9) -> DataFrame:
    """Q12. Per contest: win probabilities sum to 1, makes' sums match, and top-N probabilities rise with N."""
    s = wins.groupBy("race_id").agg(F.sum("p_win").alias("total"))
    m = makes.groupBy("race_id").agg(F.sum("p_make_win").alias("make_total"))
    up = F.lit(True)
    for a, b in zip(names, names[1:]):
        up = up & (F.col(a) <= F.col(b))
    t = tops.groupBy("race_id").agg(F.min(up).alias("monotone"))
    return s.join(m, "race_id").join(t, "race_id").select("race_id", (F.abs(F.col("total") - 1) <= tol).alias("sums_to_one"), (F.abs(F.col("make_total") - F.col("total")) <= tol).alias("makes_match"), "monotone")


def sign_sanity(worths: DataFrame, results: DataFrame) -> DataFrame:
    """Q13. One row: the best- and worst-worth entity with their mean results, and whether the best has the better (smaller) one."""
    r = results.groupBy("entity").agg(F.avg("finish").alias("mean"))
    t = worths.join(r, "entity").agg(F.max_by(F.struct("entity", "mean"), F.struct("worth", "entity")).alias("b"), F.min_by(F.struct("entity", "mean"), F.struct("worth", "entity")).alias("w"))
    return t.select(F.col("b.entity").alias("best"), F.col("w.entity").alias("worst"), (F.col("b.mean") < F.col("w.mean")).alias("sane"))


def text_rule_scan(docs: DataFrame, key: str, text: str, first: list[str], second: list[str], exempt: list[str]) -> DataFrame:
    """Q14. key and line number of lines that hold a token of both lists and no exempting phrase, quoted spans taken out."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    plain = F.lower(F.regexp_replace("line", '"[^"]*"', ""))
    has = lambda words: sum((F.when(plain.contains(w), 1).otherwise(0) for w in words), F.lit(0)) > 0
    return lines.filter(has(first) & has(second) & ~has(exempt)).select(key, "line_no")


def required_phrases(docs: DataFrame, key: str, text: str, phrases: list[str]) -> DataFrame:
    """Q14, second part. key and phrase of each required phrase that a text lacks, case folded. A null text lacks them all."""
    plain = F.lower(F.coalesce(F.col(text), F.lit("")))
    gone = F.array_compact(F.array(*[F.when(~plain.contains(p.lower()), F.lit(p)) for p in phrases]))
    return docs.select(key, F.explode(gone).alias("phrase"))


def edge_rules(edges: DataFrame, most: int = 5) -> DataFrame:
    """Q15. Edges (source, target, rank, score) that break a rule: self edge, repeated, ranks not 1, 2, ..., too many, score rising with the rank."""
    w = W.partitionBy("source").orderBy("rank", "target")
    t = edges.withColumns({"_k": F.row_number().over(w), "_p": F.lag("score").over(w), "_c": F.count("*").over(W.partitionBy("source", "target"))})
    fault = F.when(F.col("source") == F.col("target"), "self").when(F.col("_c") > 1, "repeated").when(F.col("_k") != F.col("rank"), "rank").when(F.col("rank") > most, "many").when(F.col("score") > F.col("_p"), "score")
    return t.withColumn("fault", fault).filter("fault is not null").select("source", "target", "rank", "fault")


def count_identities(df: DataFrame, parts: list[str], total: str) -> DataFrame:
    """Q16. Rows whose parts don't add up to the total."""
    return df.filter(sum((F.coalesce(c, F.lit(0)) for c in parts), F.lit(0)) != F.col(total))


def overlapping_ranges(ranges: DataFrame) -> DataFrame:
    """Q17. Pairs of ranges (name, id, first_year, last_year, note) of one name that overlap, neither with a note."""
    cols = ["name", "id", "first_year", "last_year", "note"]
    x = ranges.select(*[F.col(c).alias(f"{c}_a") for c in cols])
    y = ranges.select(*[F.col(c).alias(f"{c}_b") for c in cols])
    on = (F.col("name_a") == F.col("name_b")) & (F.col("id_a") < F.col("id_b")) & (F.col("first_year_a") <= F.col("last_year_b")) & (F.col("first_year_b") <= F.col("last_year_a"))
    return x.join(y, on).filter("note_a is null and note_b is null").select(F.col("name_a").alias("name"), F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def uncovered_years(ranges: DataFrame, active: DataFrame) -> DataFrame:
    """Q17, second part. The (name, year) of `active` that no range (name, first_year, last_year) of that name covers, each once."""
    r = ranges.select(F.col("name").alias("_name"), "first_year", "last_year")
    on = (F.col("name") == F.col("_name")) & F.col("year").between(F.col("first_year"), F.col("last_year"))
    return active.select("name", "year").distinct().join(r, on, "left_anti")


def list_mirror(texts: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Q18. Keys whose list inside a text (words of letters and digits in brackets) differs from the ordered rows (key, rank, id)."""
    want = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")).alias("_w"))
    got = F.regexp_extract_all(F.regexp_extract("text", r"\[([^\]]*)\]", 1), F.lit(r"(\w+)"), 1)
    return texts.withColumn("_g", got).join(want, key, "left").filter(~F.col("_g").eqNullSafe(F.col("_w"))).select(key)


def schema_and_vocab(df: DataFrame, columns: list[str], allowed: dict[str, list]) -> DataFrame:
    """Q19. Values outside their vocabulary, after the columns' names and order have been checked (ValueError)."""
    if df.columns != columns:
        raise ValueError(f"columns are {df.columns}, not {columns}")
    out = None
    for c, values in allowed.items():
        bad = df.filter(~F.coalesce(F.col(c).isin(values), F.lit(False))).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("column", F.lit(c))
        out = bad if out is None else out.unionByName(bad)
    return out


def gap_rules(stored: DataFrame, key: str, nth: str, gap: str) -> DataFrame:
    """Q20, second part. key and fault of rows where being the first (nth = 1) and having no gap don't go together, or a number is negative."""
    odd = F.coalesce(F.col(nth) == 1, F.lit(False)) != F.col(gap).isNull()
    fault = F.when((F.col(gap) < 0) | (F.col(nth) < 0), "negative").when(odd, "debut")
    return stored.select(key, fault.alias("fault")).filter("fault is not null")


def derived_recheck(stored: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Q20. Keys whose stored columns differ from those derived anew."""
    d = derived.select(key, *[F.col(c).alias(f"_d_{c}") for c in columns])
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"_d_{c}"))
    return stored.join(d, key, "left").filter(bad).select(key)
