"""

Runs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": ..., "value": total_seconds, "unit": "sec", "queries": {...}, "sf": ...}

Small results are collected; cleaned tables are materialised with the
``noop`` sink so that no row is sent to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabsmith.session import local_session  # noqa: E402


def _materialise(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    spark = local_session(cpus, int(os.environ.get("BENCH_PARTITIONS", "16")), app="tabsmith-bench")

    from pyspark.sql import functions as F

    from tabsmith.operators import automl, charts, clean, profile, querylog
    from tabsmith.plans.ml_queries import EVENTS_SPLIT_KEY
    from tabsmith.sources import fixtures as fx

    dirty = fx.dirty_lineitem(spark, sf_dir)
    events = fx.events(spark, sf_dir)

    def turns():
        return querylog.conversation_turns(fx.turn_log(spark, sf_dir))

    def records():
        return querylog.append_turn(turns(), "conversations", 0, 4)

    def wide(k):
        """``k`` numeric columns made of lineitem's."""
        base = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
        return dirty.select(*[(F.col(base[i % 4]) + F.sin(F.col("l_orderkey") * (i + 1))).alias(f"c{i}") for i in range(k)])

    bench = {
        # B1 profile
        "b1_dataset_summary": lambda: profile.dataset_summary(dirty).collect(),
        "b1_describe_statistics": lambda: profile.describe_statistics(dirty).collect(),
        "b1_top_values": lambda: profile.top_values(dirty).collect(),
        # B2 duplicates
        "b2_duplicate_count": lambda: clean.duplicate_count(dirty).collect(),
        "b2_remove_duplicates": lambda: _materialise(clean.remove_duplicates(dirty)),
        # B3 imputation
        "b3_fill_missing_mean": lambda: _materialise(clean.fill_missing_mean(dirty)),
        "b3_fill_missing_median": lambda: _materialise(clean.fill_missing_median(dirty)),
        "b3_fill_missing_mode": lambda: _materialise(clean.fill_missing_mode(dirty)),
        # B4 outliers
        "b4_remove_outliers": lambda: _materialise(clean.remove_outliers(dirty)),
        "b4_remove_outliers_once": lambda: _materialise(clean.remove_outliers_once(dirty)),
        # B5 correlation
        "b5_correlation_pairs": lambda: profile.correlation_pairs(dirty).collect(),
        "b5_correlation_matrix": lambda: charts.correlation_matrix(dirty).collect(),
        **{f"b5_correlation_{k}_columns": (lambda k=k: profile.correlation_pairs(wide(k)).collect()) for k in (30, 100)},
        **{f"b5_outliers_{k}_columns": (lambda k=k: _materialise(clean.remove_outliers(wide(k)))) for k in (30,)},
        # B6 chart data
        "b6_histogram": lambda: charts.histogram(events).collect(),
        "b6_box_stats": lambda: charts.box_stats(events).collect(),
        "b6_pair_grid": lambda: charts.pair_grid(events).collect(),
        "b6_kde": lambda: charts.kde(events).collect(),
        "b6_violin": lambda: charts.violin(events).collect(),
        # B7 query log
        "b7_classify_intent": lambda: _materialise(querylog.classify_intent(fx.query_log(spark, sf_dir))),
        "b7_agent_scores": lambda: _materialise(querylog.agent_scores(fx.query_log(spark, sf_dir))),
        "b7_recent_context": lambda: _materialise(querylog.recent_context(records())),
        # B8 training
        "b8_auto_train_classification": lambda: automl.auto_train(
            fx.ml_class_rule(spark, sf_dir), "level", split_key=EVENTS_SPLIT_KEY(),
            ids=("event_id",)),
    }
    if only:
        bench = {k: v for k, v in bench.items() if any(re.search(p, k) for p in only)}

    # warm-up: JVM, parquet footers, codegen caches
    profile.dataset_summary(fx.dirty_lineitem(spark, "/root/testdata/sf0.001")).collect()

    tracker = spark.sparkContext.statusTracker()

    def last_job_id() -> int:
        ids = tracker.getJobIdsForGroup(None)
        return max(ids) if ids else -1

    times, jobs = {}, {}
    for name, fn in bench.items():
        first = last_job_id()
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)
        jobs[name] = last_job_id() - first          # job ids are sequential
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "tabsmith_headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else sf_dir,
                      "spark_jobs": jobs}))
    spark.stop()


if __name__ == "__main__":
    main()
