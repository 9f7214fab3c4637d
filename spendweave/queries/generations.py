"""Group comparison at card grain."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generations as G
from ..operators import stats
from ..plans.workbench import bench_for
from .features import rounded


def _features(spark, sf):
    return bench_for(spark, sf, "card").customer_features


def _banded(spark, sf):
    return bench_for(spark, sf, "card").banded


def _battery(spark, sf):
    return bench_for(spark, sf, "card").test_battery


def age_band_cuts(spark, sf):
    return G.age_band_cuts(_features(spark, sf))


def customer_buckets(spark, sf):
    bench = bench_for(spark, sf, "card")
    return G.bucket_table(bench.customer_features, bench.cuts)


def generation_summary(spark, sf):
    return rounded(G.summary(_features(spark, sf)), "mean", "median")


def generation_median_ci(spark, sf):
    return rounded(bench_for(spark, sf, "card").intervals, "median_ci_low", "median_ci_high")


def generation_summary_ci(spark, sf):
    """Summary and bootstrap interval side by side."""
    joined = G.with_intervals(G.summary(_features(spark, sf)), bench_for(spark, sf, "card").intervals)
    return rounded(joined, "mean", "median", "median_ci_low", "median_ci_high")


def kruskal_by_generation(spark, sf):
    return rounded(G.kruskal_by(_features(spark, sf), "generation"), "statistic", "p_value", "effect_size")


def kruskal_within_band(spark, sf):
    return rounded(G.kruskal_within_band(_banded(spark, sf)), "statistic", "p_value", "effect_size")


def cramers_v(spark, sf):
    return rounded(G.associations(_banded(spark, sf)), "statistic", "p_value", "effect_size")


def generation_tests(spark, sf):
    return rounded(_battery(spark, sf), "statistic", "p_value", "effect_size", "effect_by_age_band",
                   "effect_within_age_band", "p_holm")


def holm(spark, sf):
    """Holm over the fifteen rank tests alone."""
    out = stats.holm(G.kruskal_by(_features(spark, sf), "generation")).select("metric", "p_value", "p_holm")
    return rounded(out, "p_value", "p_holm")


def artifact_summary(spark, sf):
    out = G.artifact_summary(_battery(spark, sf), bench_for(spark, sf, "card").cuts)
    return rounded(out, "median_effect_by_generation", "median_effect_by_age_band", "median_effect_within_age_band",
                   "max_effect_within_age_band")


def generation_band_mix(spark, sf):
    return G.band_mix(_banded(spark, sf))


def generation_insight_inputs(spark, sf):
    out = G.insight_inputs(G.summary(_banded(spark, sf)), _battery(spark, sf))
    return out.select("metric", *[F.round(c, 6).alias(c) for c in out.columns if c != "metric"])


QUERIES = {f.__name__: f for f in (
    age_band_cuts, customer_buckets, generation_summary, generation_summary_ci, generation_median_ci, kruskal_by_generation,
    kruskal_within_band, cramers_v, holm, generation_tests, artifact_summary, generation_band_mix,
    generation_insight_inputs)}
