"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Every query runs to completion (all rows produced) in one session. The stage tables (panel and features of both
grains) are built by the ``stages`` entries and reused afterwards, as a full run of the engine does. ``value`` is the
sum over all entries. Resamples, starts and trees are the full numbers, the replicate-heavy fits included. ``BENCH_REBUILD=1``
also times ``rebuild``, the whole
run that saves every table, beside the sum.
"""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from spendweave.plans.rebuild import rebuild  # noqa: E402
from spendweave.plans.workbench import bench_for, release_all  # noqa: E402
from spendweave.queries import registry  # noqa: E402
from spendweave.sources import adapter  # noqa: E402

HEADLINE = (
    "clean_transactions", "customer_dim", "customer_quarter", "quality_report", "trigger_events", "trigger_first_travel",
    "backtest_monthly", "backtest_monthly_unadjusted", "trigger_summary", "trigger_overlap", "trigger_placebo",
    "trigger_follow_up", "trigger_holdout", "trigger_by_segment", "trigger_sensitivity", "profile_totals",
    "profile_categories", "profile_amount_quantiles", "profile_feature_quantiles", "profile_months",
    "generation_summary", "generation_median_ci", "generation_tests", "artifact_summary", "segment_profile",
    "targeting_scores", "segment_plays", "kmeans_segments", "segment_assignments", "gmm_bic", "pca_2d",
    "holdout_assignment", "bootstrap_stability", "artifact_classifier", "k_selection")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")   # no call-site capture per expression
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    verbose = bool(os.environ.get("BENCH_VERBOSE"))

    def timed(name, work):
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)
        if verbose:
            print(name, times[name], file=sys.stderr, flush=True)

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    spark.range(1000).selectExpr("sum(id)").collect()      # start the executors before timing
    for grain in ("account", "card"):
        timed(f"stages_panel_{grain}", lambda g=grain: bench_for(spark, sf_dir, g).month_facts)
        timed(f"stages_features_{grain}", lambda g=grain: bench_for(spark, sf_dir, g).customer_features)
    for name in HEADLINE:
        timed(name, lambda n=name: drain(registry.QUERIES[n](spark, sf_dir)))
    result = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
              "queries": dict(times), "sf": os.path.basename(sf_dir.rstrip("/"))}
    release_all()
    if os.environ.get("BENCH_REBUILD"):
        with tempfile.TemporaryDirectory() as out:
            timed("rebuild", lambda: rebuild(adapter.raw_transactions(spark, sf_dir, "card"), out, repeated_names="number"))
        result["rebuild_sec"] = times["rebuild"]
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
