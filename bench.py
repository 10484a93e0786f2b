"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs twice into a sink that discards rows; the second, warm time counts.
``rows_per_sec`` divides the rows of the query's input by that time.
"""

import json
import os
import sys
import time

QUERIES = {
    "filter_project": "events", "json_get_pointer": "events", "checked_arith": "lineitem", "tumble_aggs": "events", "hop_aggs": "events", "count_tumble": "events", "count_sliding": "events", "sliding_et": "events",
    "session_max_duration": "events", "lookup_where_after": "lineitem", "versioned_lookup": "events", "interval_join_inner": "events", "window_join_left": "events", "unnest_ordinality": "documents", "route_first_match": "orders",
    "change_detect": "events", "deadband_last_output": "events", "hysteresis": "events", "dedup_ttl": "events", "resample_last": "events", "hold_for": "events", "debounce": "events", "alarm": "events", "silence": "events",
}


def count_window_over_lineitem(spark, sf_dir):
    """The count-window workload at size: every line item, keyed by part, windows of eight, min, max and sum."""
    from millrace.operators import windows
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), "l_quantity")
    value = {"k": "col", "name": "l_quantity"}
    aggs = [{"fn": f, "expr": value, "alias": f} for f in ("min", "max", "sum")]
    return windows.aggregate(df, windows.WindowSpec("count_window", size=8), ["l_suppkey"], aggs, None, ["at"])


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from millrace.plans.queries import QUERIES as registered
    from millrace.session import local_session, ship_package

    spark = local_session(cpus, **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8"})
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    todo = {name: (registered[name], source) for name, source in QUERIES.items()} | {"count_window_lineitem": (count_window_over_lineitem, "lineitem")}
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in {s for _, s in todo.values()}}
    took, rate = {}, {}
    for name, (query, source) in todo.items():
        for _ in range(2):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
        rate[name] = round(rows[source] / took[name])
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows_per_sec": rate, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
