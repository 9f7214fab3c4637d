"""The full run: raw transactions in, every result table out."""
from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..config import TriggerRules
from ..operators import backtest, generations, quality, segmentation, segments, targeting, triggers
from ..sources import catalog, files
from . import stages
from .workbench import Workbench


@dataclass(frozen=True)
class Effort:
    """How many replicates and starts the resampling and fitting steps take."""

    resamples: int = config.N_RESAMPLES
    placebo: int = config.N_PLACEBO
    ks: tuple[int, ...] = config.K_RANGE
    chosen_k: int = config.CHOSEN_K
    starts: int = 10
    bootstraps: int = 100
    bootstrap_starts: int = 5
    mixture_starts: int = 3
    trees: int = 300
    depth: int = segmentation.DEEPEST


def rebuild(raw: DataFrame, out: str, rules: TriggerRules = TriggerRules(), effort: Effort = Effort(),
            repeated_names: str = "stop") -> None:
    """Run all steps and save the results below ``out``. Stage tables go to the shared folder.

    Two segments that get the same name by the rules ``stop`` the run, or are told apart by their number with ``repeated_names="number"``.
    """
    if repeated_names not in ("stop", "number"):
        raise ValueError(f"unknown choice {repeated_names!r}")
    bench = Workbench(raw)
    try:
        _run(bench, out, rules, effort, repeated_names)
    finally:
        bench.release()


def _run(bench: Workbench, out: str, rules: TriggerRules, effort: Effort, repeated_names: str) -> None:
    rows = bench.transactions           # whole rows are needed, so the source is read for them first
    features = bench.customer_features
    quality.require_clean(quality.report(features, rows, bench.customers))
    files.write_parquet(features, f"{out}/{catalog.FEATURES}")

    banded, tests = bench.banded, bench.test_battery
    catalog.save_csv(generations.summary_with_ci(features, effort.resamples), out, "generation_summary")
    catalog.save_csv(tests.orderBy(F.desc("effect_size")), out, "generation_tests")
    catalog.save_csv(generations.bucket_table(features, bench.cuts), out, "customer_generator_buckets")
    catalog.save_csv(generations.band_mix(banded), out, "generation_band_mix")
    catalog.save_csv(generations.band_definitions(banded), out, "age_band_definitions")
    files.write_json(generations.artifact_summary(tests, bench.cuts), f"{out}/artifact_check")

    labels, profiles = _segment(bench, out, effort, repeated_names)
    scored = features.join(labels.select("customer_id", "segment_name"), "customer_id")
    scores = stages.keep_rows(targeting.score_segments(scored), "scores")
    catalog.save_csv(scores.orderBy("benefit", "rank"), out, "targeting_scores")
    _backtest(bench.customer_month, labels, profiles, scores, out, rules, effort)
    for stage in (labels, profiles, scores):
        stages.forget(stage)


def _segment(bench: Workbench, out: str, effort: Effort, repeated_names: str) -> tuple[DataFrame, DataFrame]:
    """Labels (with the shown name and the name by rule) and profiles, both as stages."""
    matrix = bench.matrix
    table = segmentation.select_k(matrix, effort.ks, effort.starts, effort.bootstraps, effort.bootstrap_starts,
                                  effort.mixture_starts)
    catalog.save_csv(table, out, "k_selection")
    model = segmentation.fit_kmeans(matrix, effort.chosen_k, effort.starts)
    segmented = stages.keep(segmentation.segment_features(bench.banded, matrix, model), "segmented", "customer_id")
    by_rule = segments.profile(segmented)
    if repeated_names == "stop":
        quality.require_unique_names(by_rule)
    profiles = stages.keep_rows(segments.unique_names(by_rule), "profiles")
    coordinates, explained = segmentation.project(matrix)
    rule_names = F.broadcast(by_rule.select("segment_id", F.col("segment_name").alias("rule_name")))      # a row per segment
    assigned = segmentation.assignments(segmented, profiles, coordinates)
    labels = stages.keep(assigned.join(rule_names, "segment_id"), "labels", "customer_id")
    catalog.save_csv(profiles.orderBy("segment_id"), out, "segment_profiles")
    catalog.save_csv(labels.drop("rule_name"), out, "segment_assignments")
    catalog.save_csv(segmentation.attribute_associations(segmented, "segment_id"), out, "attribute_associations")
    check = segmentation.artifact_check(segmented, "segment_id", effort.trees, effort.depth)
    repeated = by_rule.groupBy("segment_name").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    files.write_json(check.withColumn("pca_variance_explained", F.array(*[F.lit(v) for v in explained]))
                     .withColumn("segments_sharing_a_name", F.lit(repeated if repeated > 1 else 0))
                     .withColumn("chosen_k", F.lit(effort.chosen_k)), f"{out}/generator_check")
    stages.forget(segmented)
    return labels, profiles


def _backtest(panel: DataFrame, labels: DataFrame, profiles: DataFrame, scores: DataFrame, out: str,
              rules: TriggerRules, effort: Effort) -> None:
    events = stages.keep(triggers.trigger_events(panel, rules), "events", "customer_id")
    unadjusted = triggers.trigger_events(panel, rules.override(portfolio_adjust=0))
    by_rule = labels.select("customer_id", F.col("rule_name").alias("segment_name"))     # shown names may carry a number
    summary, holdout = backtest.summary(events, panel), backtest.holdout_design(events, panel)
    fired = backtest.by_segment(events, labels)
    results = {
        "trigger_events": triggers.ordered(events),
        "trigger_backtest_monthly": backtest.monthly(events, panel).orderBy("month", "trigger_name"),
        "trigger_backtest_monthly_unadjusted": backtest.monthly(unadjusted, panel).orderBy("month", "trigger_name"),
        "trigger_summary": summary,
        "trigger_overlap": backtest.overlap(events),
        "trigger_placebo_test": backtest.placebo(panel, rules, effort.placebo),
        "trigger_follow_up": backtest.follow_up_with_segment(events, panel, by_rule, config.SEGMENT_NAMES["travel"][1]),
        "trigger_holdout_design": holdout,
        "trigger_by_segment": fired,
        "trigger_sensitivity": backtest.sensitivity(panel),
        "segment_plays": targeting.segment_plays(profiles, scores, fired),
        "trigger_plays": targeting.trigger_plays(summary, holdout, rules),
    }
    for name, table in results.items():
        catalog.save_csv(table, out, name)
    params = {**asdict(rules), "holdout_share": config.HOLDOUT_SHARE}
    files.write_json(panel.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in params.items()]),
                     f"{out}/trigger_params")
    stages.forget(events)
