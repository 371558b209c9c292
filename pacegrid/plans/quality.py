"""Queries of the data-quality checks, on tables with faults put in by a rule on their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conform as C
from ..operators import history as H
from ..operators import pricing as P
from ..operators import quality as Q
from .history import METRIC, metric
from .laps import CLOSE, closers_of
from .pricing import DRAWS, MAKES, TOP, field
from .rank_model import EDGES, near
from .registry import query


@query("q01_reconcile", "entries", """select race_id, count(*) * 4 as cells, (count(*) * 4 - count(*) filter (where race_id % 5 = 1) - count(*) filter (where race_id % 7 = 1 and driver_id % 3 = 0))::bigint as exact, count(*) filter (where race_id % 5 = 1) as within,
 case when count(*) filter (where race_id % 7 = 1 and driver_id % 3 = 0) > 0 then 'fail' when race_id % 5 = 1 then 'pass-with-note' else 'pass' end as verdict from entries group by 1""")
def q01(v):
    a = v.entries.select("race_id", "driver_id", F.col("finish").cast("double").alias("finish"), "start", "status", F.lit(None).cast("string").alias("note"))
    b = a.withColumns({"finish": F.when(F.col("race_id") % 5 == 1, F.col("finish") * (1 + 1e-10)).otherwise(F.col("finish")), "start": F.when((F.col("race_id") % 7 == 1) & (F.col("driver_id") % 3 == 0), F.col("start") + 1).otherwise(F.col("start")), "note": F.lit(" ")})
    return Q.reconcile(a, b, ["race_id", "driver_id"], "race_id", {"finish": 1e-9})


@query("q02_unexpected_rows", "entries", "select race_id, driver_id from entries where race_id between 199601 and 199912 and driver_id % 5 = 0")
def q02(v):
    return Q.unexpected_rows(v.entries, v.entries.filter("driver_id % 5 <> 0").select("race_id", "driver_id"), ["race_id", "driver_id"], F.col("race_id").between(199601, 199912))


@query("q03_feature_parity", "entries", """select race_id, driver_id, 'start' as "column", 'null' as kind from entries where driver_id % 4 = 0 and driver_id % 7 <> 0 union all select race_id, driver_id, 'finish', 'value' from entries where race_id % 6 = 0 and driver_id % 7 <> 0
 union all select race_id, driver_id, c, 'membership' from entries, (values ('start'), ('finish')) x(c) where driver_id % 7 = 0""")
def q03(v):
    a = v.entries.select("race_id", "driver_id", "start", "finish")
    b = a.filter("driver_id % 7 <> 0").withColumns({"start": F.when(F.col("driver_id") % 4 != 0, F.col("start")), "finish": F.when(F.col("race_id") % 6 == 0, F.col("finish") * 1.001).otherwise(F.col("finish"))})
    return Q.feature_parity(a, b, ["race_id", "driver_id"], ["start", "finish"], 1e-6)


@query("q04_discordant_pairs", "entries", """select a.race_id, count(*) as pairs, count(*) filter (where sign(a.start - b.start) <> sign(a.finish // 3 - b.finish // 3)) as discordant, count(*) filter (where sign(a.start - b.start) <> sign(a.finish // 3 - b.finish // 3) and a.finish // 3 = b.finish // 3) as near_ties
 from entries a join entries b on a.race_id = b.race_id and a.driver_id < b.driver_id group by 1""")
def q04(v):
    return Q.discordant_pairs(v.entries.withColumn("f3", F.floor(F.col("finish") / 3)), "race_id", "start", "f3")


@query("q05_one_winner", "entries", "select race_id, count(*) filter (where f = 1) as winners from (select race_id, case when race_id % 4 = 0 and finish = 2 then 1 when race_id % 9 = 0 and finish = 1 then 5 else finish end as f from entries) group by 1 having count(*) filter (where f = 1) <> 1")
def q05(v):
    f = F.when((F.col("race_id") % 4 == 0) & (F.col("finish") == 2), 1).when((F.col("race_id") % 9 == 0) & (F.col("finish") == 1), 5).otherwise(F.col("finish"))
    return Q.one_winner(v.entries.withColumn("finish", f), "race_id", "finish")


@query("q06_duplicate_keys", "", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def q06(v):
    return Q.duplicate_keys(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("q07_ref_integrity", "", "select distinct o_custkey as k, 'dimension' as missing_in from orders where o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 0) union all select c_custkey, 'fact' from customer where c_custkey % 10 <> 0 and c_custkey not in (select o_custkey from orders)")
def q07(v):
    return Q.ref_integrity(v.table("orders").select(F.col("o_custkey").alias("k")), v.table("customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("q08_floor_rule", "metric", "select venue, era_key from (select venue, family, era_key, count(*) as n from metric group by 1, 2, 3) where n < 3 and substr(venue, 2)::int % 2 = 0", METRIC)
def q08(v):
    p = H.profile_blend(metric(v), floor=3)
    even = F.substring("venue", 2, 2).cast("int") % 2 == 0
    bad = p.withColumn("value", F.when(even & F.col("backstop"), F.col("pool") + 1).otherwise(F.col("value")))
    return Q.floor_rule(bad, "n", "value", "pool", 3).select("venue", "era_key")


@query("q09_null_rule", "clo", "select race_id, driver_id from clo where (closers is not null) <> (driver_id % 2 = 0)", CLOSE)
def q09(v):
    return Q.null_rule(closers_of(v), v.entries.filter("driver_id % 2 = 0"), ["race_id", "driver_id"], "closers").select("race_id", "driver_id")


@query("q10_interval_tiling", "contests", "select venue, 1998 as start_year from contests where substr(venue, 2)::int % 3 = 0 group by 1 union all select venue, 1995 from contests where substr(venue, 2)::int % 4 = 0 group by 1")
def q10(v):
    n = F.substring("venue", 2, 2).cast("int")
    names = v.contests.select("venue").distinct()
    a = names.select("venue", F.lit(1995).alias("start_year"), F.when(n % 4 == 0, 1996).otherwise(1997).alias("end_year"))
    b = names.select("venue", F.lit(1998).alias("start_year"), F.when(n % 3 == 0, 2001).otherwise(9999).alias("end_year"))
    return Q.interval_tiling(a.unionByName(b), "venue", "start_year", "end_year").select("venue", "start_year")


@query("q11_complete_cross", "", "select p_partkey as id, n as name, case when p_partkey % 5 = 0 and n = 'a' then 'missing' else 'range' end as fault from part, (values ('a'), ('b')) x(n) where (p_partkey % 5 = 0 and n = 'a') or (p_partkey % 11 = 0 and n = 'b')")
def q11(v):
    ids = v.table("part").select(F.col("p_partkey").alias("id"))
    names = v.spark.createDataFrame([("a",), ("b",)], "name string")
    t = ids.join(F.broadcast(names)).filter("not (id % 5 = 0 and name = 'a')").withColumn("score", F.when((F.col("id") % 11 == 0) & (F.col("name") == "b"), 11.0).otherwise(5.0))
    return Q.complete_cross(ids, names, t)


@query("q12_prob_coherence", "win makes top", """select race_id, true as sums_to_one, race_id % 5 <> 0 as makes_match, bool_and(p_top1 <= p_top5 and p_top5 <= p_top10) as monotone from top group by 1""", {**MAKES, **TOP})
def q12(v):
    f = field(v)
    makes = P.make_markets(f).withColumn("p_make_win", F.when(F.col("race_id") % 5 == 0, F.col("p_make_win") * 2).otherwise(F.col("p_make_win")))
    return Q.prob_coherence(P.win_prob(f), makes, P.sampled_tops(f, DRAWS, [1, 5, 10]), ["p_top1", "p_top5", "p_top10"])


@query("q13_sign_sanity", "entries", "with m as (select team_name as entity, avg(finish) as mean, -avg(start) as worth from entries group by 1) select (select entity from m order by round(worth, 9) desc, entity desc limit 1) as best, (select entity from m order by round(worth, 9), entity limit 1) as worst, (select mean from m order by round(worth, 9) desc, entity desc limit 1) < (select mean from m order by round(worth, 9), entity limit 1) as sane")
def q13(v):
    e = v.entries.withColumnRenamed("team_name", "entity")
    return Q.sign_sanity(e.groupBy("entity").agg(F.round(-F.avg("start"), 9).alias("worth")), e)


@query("q14_text_rule_scan", "", """select doc_id, (i - 1)::int as line_no from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i from (select doc_id, string_split(text, chr(10)) as l from documents))
 where (contains(lower(regexp_replace(line, '"[^"]*"', '', 'g')), 'the ') or contains(lower(regexp_replace(line, '"[^"]*"', '', 'g')), 'der ')) and contains(lower(regexp_replace(line, '"[^"]*"', '', 'g')), 'on') and not contains(lower(regexp_replace(line, '"[^"]*"', '', 'g')), 'license')""")
def q14(v):
    return Q.text_rule_scan(v.table("documents"), "doc_id", "text", ["the ", "der "], ["on"], ["license"])


PHRASES = ["the", "license", "data"]


@query("q14_required_phrases", "", f"select doc_id, phrase from documents, (select unnest({PHRASES}) as phrase) where not contains(lower(coalesce(text, '')), phrase)")
def q14_required(v):
    return Q.required_phrases(v.table("documents"), "doc_id", "text", PHRASES)


@query("q15_edge_rules", "near", """select source, target, rank, fault from (select *, case when source = target then 'self' when c > 1 then 'repeated' when k <> rank then 'rank' when rank > 5 then 'many' when score > p then 'score' end as fault from (
 select *, row_number() over w as k, lag(score) over w as p, count(*) over (partition by source, target) as c from (select venue as source, case when rank = 2 and venue = 'v03' then venue else other end as target, rank + case when venue = 'v05' then 1 else 0 end as rank, case when rank = 3 then 9 else round(sim, 6) end as score from near where rank <= 6) window w as (partition by source order by rank, target))) where fault is not null""", EDGES)
def q15(v):
    t = near(v).filter("rank <= 6").select(
        F.col("venue").alias("source"), F.when((F.col("rank") == 2) & (F.col("venue") == "v03"), F.col("venue")).otherwise(F.col("other")).alias("target"),
        (F.col("rank") + F.when(F.col("venue") == "v05", 1).otherwise(0)).alias("rank"), F.when(F.col("rank") == 3, 9.0).otherwise(F.round("sim", 6)).alias("score"),
    )
    return Q.edge_rules(t)


@query("q16_count_identities", "entries", "select race_id from entries group by 1 having count(*) filter (where status = 'running') + count(*) filter (where status = 'accident') <> count(*)")
def q16(v):
    t = v.entries.groupBy("race_id").agg(F.count_if(F.col("status") == "running").alias("a"), F.count_if(F.col("status") == "accident").alias("b"), F.count("*").alias("n"))
    return Q.count_identities(t, ["a", "b"], "n").select("race_id")


#: Two ranges a venue, with a documented or an undocumented overlap at some and a year between them at others.
RANGES = {"numbered": ("contests", "select distinct venue as name, substr(venue, 2)::int as k from contests"),
 "ranges": ("numbered", """select name, 1 as id, 1995 as first_year, case when k % 3 = 0 then 1998 else 1997 end as last_year, case when k % 2 = 0 then 'split' end as note from numbered
 union all select name, 2, case when k % 5 = 0 then 1999 else 1998 end, 9999, null from numbered""")}


def venue_ranges(v):
    n = F.substring("venue", 2, 2).cast("int")
    names = v.contests.select(F.col("venue").alias("name"), n.alias("k")).distinct()
    a = names.select("name", F.lit(1).alias("id"), F.lit(1995).alias("first_year"), F.when(F.col("k") % 3 == 0, 1998).otherwise(1997).alias("last_year"), F.when(F.col("k") % 2 == 0, "split").alias("note"))
    b = names.select("name", F.lit(2).alias("id"), F.when(F.col("k") % 5 == 0, 1999).otherwise(1998).alias("first_year"), F.lit(9999).alias("last_year"), F.lit(None).cast("string").alias("note"))
    return a.unionByName(b)


@query("q17_overlapping_ranges", "ranges", "select x.name, x.id as a, y.id as b from ranges x join ranges y on x.name = y.name and x.id < y.id and x.first_year <= y.last_year and y.first_year <= x.last_year where x.note is null and y.note is null", RANGES)
def q17(v):
    return Q.overlapping_ranges(venue_ranges(v))


@query("q17_uncovered_years", "ranges contests", "select distinct venue as name, year from contests c where not exists (select 1 from ranges r where r.name = c.venue and c.year between r.first_year and r.last_year)", RANGES)
def q17_uncovered(v):
    return Q.uncovered_years(venue_ranges(v), v.contests.select(F.col("venue").alias("name"), "year"))


@query("q18_list_mirror", "entries", "select race_id from entries where race_id % 4 = 0 group by 1 having count(*) > 1")
def q18(v):
    rows = v.entries.select("race_id", F.col("finish").alias("rank"), F.col("driver_id").alias("id"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string"))
    texts = rows.groupBy("race_id").agg(ordered.alias("l")).select("race_id", F.concat(F.lit("order ["), F.array_join(F.when(F.col("race_id") % 4 == 0, F.reverse("l")).otherwise(F.col("l")), ", "), F.lit("]")).alias("text"))
    return Q.list_mirror(texts, rows, "race_id")


@query("q19_schema_and_vocab", "entries", "select 'status' as \"column\", status as value, count(*) as n from entries where status not in ('running', 'accident') group by 2 union all select 'make', make, count(*) from entries where make not in ('ASIA', 'EUROPE') group by 2")
def q19(v):
    e = v.entries
    return Q.schema_and_vocab(e, ["race_id", "driver_id", "finish", "start", "status", "team_name", "make", "laps_completed"], {"status": ["running", "accident"], "make": ["ASIA", "EUROPE"]}).select("column", "value", "n")


#: Stored columns with faults: a visit counted twice, gaps one too large or lost, and the same derived anew from the contests.
STORED = {"derived": ("contests", """select race_id, (select count(*) from contests p where p.venue = t.venue and p.race_seq <= t.race_seq) as nth, year - (select max(p.year) from contests p where p.venue = t.venue and p.race_seq < t.race_seq) as gap from contests t"""),
 "stored": ("derived", "select race_id, case when race_id % 6 = 0 then nth + 1 else nth end as nth, case when race_id % 7 = 0 then null when race_id % 11 = 0 then gap - 2 else gap end as gap from derived")}


def stored_features(d):
    nth, gap = F.col("nth_at_venue"), F.col("seasons_since")
    return d.withColumns({"nth_at_venue": F.when(F.col("race_id") % 6 == 0, nth + 1).otherwise(nth), "seasons_since": F.when(F.col("race_id") % 7 == 0, None).when(F.col("race_id") % 11 == 0, gap - 2).otherwise(gap)})


@query("q20_gap_rules", "stored", "select race_id, case when gap < 0 or nth < 0 then 'negative' else 'debut' end as fault from stored where gap < 0 or nth < 0 or (nth = 1) <> (gap is null)", STORED)
def q20_gaps(v):
    return Q.gap_rules(stored_features(C.schedule_features(v.contests, ["q1"], 1998)), "race_id", "nth_at_venue", "seasons_since")


@query("q20_derived_recheck", "stored derived", "select race_id from stored s join derived d using (race_id) where s.nth is distinct from d.nth or s.gap is distinct from d.gap", STORED)
def q20(v):
    d = C.schedule_features(v.contests, ["q1"], 1998)
    s = stored_features(d)
    return Q.derived_recheck(s, d, "race_id", ["nth_at_venue", "seasons_since"])


