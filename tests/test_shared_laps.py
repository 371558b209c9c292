"""Laps are joined and numbered once a query, and what meets them is short or keyed by the entrant."""

from __future__ import annotations

import itertools
import statistics

import pytest

from pacegrid import catalogue
from pacegrid.operators import laps

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["l07_entrant_race", "l14_restart_volatility", "l15_restart_retention", "l16_theil_sen", "l34_position_premium", "l36_contender_sensitivity", "z04_gap_ahead", "m09_wilcoxon", "m21_neighbours", "m24_partition_tree"])
def test_lines_are_not_joined_again(spark, name):
    files = catalogue.queries()[name](spark, SMALLEST).inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "orders" in f]


def test_run_slopes_take_a_run_in_place(spark):
    times = {(1, 1): [9.0, 8.5, 8.75, 7.0, 6.5, 9.5, 9.0, 8.0], (1, 2): [5.0, 5.5, 4.0, 4.5, 6.0, 3.0, 2.0, 2.5]}
    rows = [(r, d, k + 1, t, 1) for (r, d), ts in times.items() for k, t in enumerate(ts)]
    green = spark.createDataFrame(rows, "race_id int, driver_id long, lap int, lap_time double, running_pos int")
    pits = spark.createDataFrame([(1, 1, 5), (1, 1, 5), (1, 1, None), (1, 3, 2)], "race_id int, driver_id long, lap_count int")
    got = laps.run_slopes(green, pits, 3)
    found = sorted((r["driver_id"], round(r["slope"], 9)) for r in got.collect())
    stretches = [(1, range(4)), (1, range(5, 8)), (2, range(8))]
    slope = lambda ts, span: statistics.median((ts[b] - ts[a]) / (b - a) for a, b in itertools.combinations(span, 2))
    assert found == sorted((d, round(slope(times[1, d], span), 9)) for d, span in stretches)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the stops; before, the laps met themselves as well
