"""Data profile at card grain."""
from __future__ import annotations

from .. import config
from ..operators import profile
from ..plans.workbench import bench_for
from .features import rounded


def _bench(spark, sf):
    return bench_for(spark, sf, "card")


def profile_sources(spark, sf):
    return profile.sources(_bench(spark, sf).raw)


def profile_totals(spark, sf):
    return profile.totals(_bench(spark, sf).raw)


def profile_flagged_only(spark, sf):
    return profile.flagged_only(_bench(spark, sf).raw)


def profile_consistency(spark, sf):
    return profile.consistency(_bench(spark, sf).customers)


def profile_clean_totals(spark, sf):
    return profile.clean_totals(_bench(spark, sf).transactions)


def profile_categories(spark, sf):
    return rounded(profile.categories(_bench(spark, sf).transactions), "median_ticket")


def profile_amount_quantiles(spark, sf):
    out = profile.amount_quantiles(_bench(spark, sf).transactions)
    return rounded(out, "p01", "p25", "p50", "p75", "p95", "p99")


def profile_feature_quantiles(spark, sf):
    return rounded(profile.feature_quantiles(_bench(spark, sf).customer_features), "p25", "p50", "mean", "p75")


def profile_generations(spark, sf):
    return rounded(profile.generations(_bench(spark, sf).customer_features), "median_monthly_spend")


def profile_months(spark, sf):
    return profile.months(_bench(spark, sf).customer_month)


def profile_tiers(spark, sf):
    return profile.tiers(_bench(spark, sf).customer_features)


def profile_hour_blocks(spark, sf):
    return profile.hour_blocks(_bench(spark, sf).transactions)


def profile_ticket_bands(spark, sf):
    return profile.ticket_bands(_bench(spark, sf).transactions)


DESCRIBED = (*config.CLUSTER_COLUMNS, "recency_days", "avg_qoq_spend_change", "avg_yoy_spend_change")


def feature_description(spark, sf):
    return rounded(profile.describe(_bench(spark, sf).customer_features, DESCRIBED),
                   "mean", "std", "min", "median", "max")


QUERIES = {f.__name__: f for f in (
    profile_sources, profile_totals, profile_flagged_only, profile_consistency, profile_clean_totals,
    profile_categories, profile_amount_quantiles, profile_feature_quantiles, profile_generations, profile_months,
    profile_tiers, profile_hour_blocks, profile_ticket_bands, feature_description)}
