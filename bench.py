"""Times headline queries on the tables of $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "w05_wf_features", "w13_profile_asof", "w22_pairwise_win_share", "l03_pace_variants", "l05_fixed_effect_pace", "l11_loop_metrics", "l16_theil_sen",
    "m01_pl_nll_grad", "m06_spearman", "m19_venue_pair_similarity", "p01_win_prob", "d05_grade_quotes", "c13_dedupe_conflicts", "c15_resolve_ids", "b01_latest_version",
    "q06_duplicate_keys", "t01_state_changes",
]


def main() -> None:
    root, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pacegrid import catalogue

    queries, took = catalogue.queries(), {}
    spark.read.parquet(f"{root}/orders.parquet").count()
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, root).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
