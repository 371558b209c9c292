"""Contest views over order and line-item tables: an order month is a contest, a supplier an entrant, a line item a lap."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize


class Views:
    """The views of one folder of tables. Laps are numbered once, in a written table that the other views are taken from; short lists (contests,
    flags, a contest's median) are written too, so that their size is known and joins with them need no shuffle."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def contests(self) -> DataFrame:
        """race_id, race_seq, year, month, venue, family, ttype, era_key; one row an order month."""
        months = self.table("orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
        race_id = (F.col("year") * 100 + F.col("month")).cast("int")
        found = months.select(
            race_id.alias("race_id"),
            F.row_number().over(W.orderBy(race_id)).alias("race_seq"),  # a row a month: a tiny list
            "year",
            "month",
            F.format_string("v%02d", "month").alias("venue"),
            F.concat(F.lit("q"), F.floor((F.col("month") + 2) / 3).cast("int").cast("string")).alias("family"),
            F.element_at(F.array(*map(F.lit, ("SS", "INT", "SHORT", "ROAD"))), F.col("month") % 4 + 1).alias("ttype"),
            F.when(F.col("year") <= 1997, "e1").when(F.col("year") <= 1999, "e2").otherwise("e3").alias("era_key"),
        )
        return materialize(found, "contests")

    @cached_property
    def lines(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int").alias("race_id"))
        return self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("l_suppkey", "driver_id")

    @cached_property
    def numbered(self) -> DataFrame:
        """race_id, driver_id, lap, price, quantity, returnflag, linestatus, tax, cum; written, an entrant's laps of a contest together."""
        mine = W.partitionBy("race_id", "driver_id")
        order = mine.orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
        rows = self.lines.select(
            "race_id", "driver_id", F.row_number().over(order).alias("lap"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"),
            F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), F.col("l_tax").alias("tax"),
            F.round(F.sum("l_extendedprice").over(order.rowsBetween(W.unboundedPreceding, 0)), 2).alias("cum"),
        )
        return materialize(rows, "numbered")

    @cached_property
    def laps(self) -> DataFrame:
        """race_id, driver_id, lap, lap_time, running_pos, returnflag, linestatus, tax."""
        place = F.row_number().over(W.partitionBy("race_id", "lap").orderBy(F.desc("cum"), "driver_id"))
        return self.numbered.select("race_id", "driver_id", "lap", (F.col("price") / F.col("quantity")).alias("lap_time"), "returnflag", "linestatus", "tax", place.alias("running_pos"))

    @cached_property
    def lap_flags(self) -> DataFrame:
        """race_id, lap, flag_state (1 green, 2 caution)."""
        flags = self.numbered.select("race_id", "lap").distinct().withColumn("flag_state", F.when((F.col("race_id") + F.col("lap")) % 5 == 0, 2).otherwise(1))
        return materialize(flags, "flags")

    @cached_property
    def entries(self) -> DataFrame:
        """race_id, driver_id, finish, start, status, team_name, make, laps_completed."""
        plain = self.lines.select("race_id", "driver_id", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("returnflag"))
        rows = self.numbered if "numbered" in self.__dict__ else plain  # laps that are written already aren't joined again
        sums = rows.groupBy("race_id", "driver_id").agg(
            F.round(F.sum("price"), 2).alias("rev"), F.round(F.sum("quantity"), 2).alias("qty"), F.count("*").alias("laps_completed"),
            F.count_if(F.col("returnflag") == "R").alias("n_r"), F.count_if(F.col("returnflag") == "A").alias("n_a"),
        )
        race = W.partitionBy("race_id")
        named = (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("driver_id"), F.col("n_name").alias("team_name"), F.col("r_name").alias("make"))
        )
        return sums.join(named, "driver_id").select(
            "race_id", "driver_id",
            F.row_number().over(race.orderBy(F.desc("rev"), "driver_id")).alias("finish"),
            F.row_number().over(race.orderBy(F.desc("qty"), "driver_id")).alias("start"),
            F.when(F.col("n_r") >= 5, "accident").when(F.col("n_a") >= 5, "engine").otherwise("running").alias("status"),
            "team_name", "make", "laps_completed",
        )

    @cached_property
    def pit_stops(self) -> DataFrame:
        """race_id, driver_id, lap_count, pit_in_rank, pit_out_rank, pit_stop_duration, n_tires."""
        out = F.lead("running_pos").over(W.partitionBy("race_id", "driver_id").orderBy("lap"))
        return (
            self.laps.withColumn("out_rank", out)
            .filter("returnflag = 'R' and lap % 3 = 0")
            .select("race_id", "driver_id", F.col("lap").alias("lap_count"), F.col("running_pos").alias("pit_in_rank"), F.col("out_rank").alias("pit_out_rank"),
                    (F.col("tax") * 100 + 10).alias("pit_stop_duration"), F.when(F.col("tax") < 0.03, 2).otherwise(4).alias("n_tires"))
        )

    @cached_property
    def runs(self) -> DataFrame:
        """entries with their contest's columns and the entrant's pace: the table of entrant history."""
        pace = self.laps.groupBy("race_id", "driver_id").agg(F.median("lap_time").alias("m"), F.count("*").alias("n"))
        field = materialize(self.laps.groupBy("race_id").agg(F.median("lap_time").alias("f")), "field-medians")
        pace = pace.join(field, "race_id").select("race_id", "driver_id", F.when(F.col("n") >= 3, F.col("m") / F.col("f")).alias("pace"))
        return self.entries.join(self.contests, "race_id").join(pace, ["race_id", "driver_id"], "left")


#: The same views in SQL, for the queries' twins. Each names the views it reads.
SQL: dict[str, tuple[str, str]] = {
    "contests": ("", """select race_id, row_number() over (order by race_id) as race_seq, yr as year, mon as month,
 'v' || lpad(cast(mon as varchar), 2, '0') as venue, 'q' || cast((mon + 2) // 3 as varchar) as family,
 case mon % 4 when 0 then 'SS' when 1 then 'INT' when 2 then 'SHORT' else 'ROAD' end as ttype,
 case when yr <= 1997 then 'e1' when yr <= 1999 then 'e2' else 'e3' end as era_key
 from (select distinct cast(year(o_orderdate) * 100 + month(o_orderdate) as int) as race_id, cast(year(o_orderdate) as int) as yr,
  cast(month(o_orderdate) as int) as mon from orders) x"""),
    "laps": ("", """select race_id, driver_id, lap, lap_time, returnflag, linestatus, tax,
 row_number() over (partition by race_id, lap order by cum desc, driver_id) as running_pos
 from (select race_id, driver_id, lap, lap_time, returnflag, linestatus, tax,
  round(sum(price) over (partition by race_id, driver_id order by lap rows between unbounded preceding and current row), 2) as cum
  from (select cast(year(o.o_orderdate) * 100 + month(o.o_orderdate) as int) as race_id, l.l_suppkey as driver_id,
   l.l_extendedprice as price, l.l_extendedprice / l.l_quantity as lap_time, l.l_returnflag as returnflag, l.l_linestatus as linestatus, l.l_tax as tax,
   row_number() over (partition by year(o.o_orderdate) * 100 + month(o.o_orderdate), l.l_suppkey
    order by l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice, l.l_quantity) as lap
   from lineitem l join orders o on l.l_orderkey = o.o_orderkey) a) b"""),
    "lap_flags": ("laps", "select distinct race_id, lap, case when (race_id + lap) % 5 = 0 then 2 else 1 end as flag_state from laps"),
    "entries": ("", """select e.race_id, e.driver_id, row_number() over (partition by e.race_id order by e.rev desc, e.driver_id) as finish,
 row_number() over (partition by e.race_id order by e.qty desc, e.driver_id) as start,
 case when e.n_r >= 5 then 'accident' when e.n_a >= 5 then 'engine' else 'running' end as status,
 n.n_name as team_name, r.r_name as make, e.n_lines as laps_completed
 from (select cast(year(o.o_orderdate) * 100 + month(o.o_orderdate) as int) as race_id, l.l_suppkey as driver_id,
   round(sum(l.l_extendedprice), 2) as rev, round(sum(l.l_quantity), 2) as qty, count(*) as n_lines,
   sum(case when l.l_returnflag = 'R' then 1 else 0 end) as n_r, sum(case when l.l_returnflag = 'A' then 1 else 0 end) as n_a
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey group by 1, 2) e
 join supplier s on s.s_suppkey = e.driver_id join nation n on n.n_nationkey = s.s_nationkey join region r on r.r_regionkey = n.n_regionkey"""),
    "pit_stops": ("laps", """select race_id, driver_id, lap as lap_count, running_pos as pit_in_rank, out_rank as pit_out_rank,
 10 + tax * 100 as pit_stop_duration, case when tax < 0.03 then 2 else 4 end as n_tires
 from (select *, lead(running_pos) over (partition by race_id, driver_id order by lap) as out_rank from laps) p
 where returnflag = 'R' and lap % 3 = 0"""),
    "runs": ("entries contests laps", """select e.*, c.race_seq, c.year, c.month, c.venue, c.family, c.ttype, c.era_key, p.pace
 from entries e join contests c using (race_id) left join
 (select race_id, driver_id, case when n >= 3 then m / f end as pace from
  (select race_id, driver_id, median(lap_time) as m, count(*) as n from laps group by 1, 2) join
  (select race_id, median(lap_time) as f from laps group by 1) using (race_id)) p using (race_id, driver_id)"""),
    "green": ("laps lap_flags", """select l.* from laps l join lap_flags f using (race_id, lap) where f.flag_state = 1"""),
}


def with_views(names: str, body: str, extra: dict[str, tuple[str, str]] | None = None) -> str:
    """body with the named views, and those they read, as common table expressions."""
    known, done = SQL | (extra or {}), {}

    def add(name: str) -> None:
        for n in known[name][0].split():
            add(n)
        done.setdefault(name, known[name][1])

    for n in names.split():
        add(n)
    if not done:
        return body
    head = ",\n".join(f"{n} as ({sql})" for n, sql in done.items())
    lead = body.lstrip()
    if lead[:5].lower() == "with ":
        recursive = "recursive " if lead[5:15].lower() == "recursive " else ""
        return f"with {recursive}{head},\n{lead[5 + len(recursive):]}"
    return f"with {head}\n{body}"
