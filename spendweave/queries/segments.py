"""Segments from given labels, targeting scores, plays and report tables."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import backtest, generations, report, segments, stats, targeting
from ..plans.workbench import bench_for
from ..sources import adapter
from .backtest import RULES, backtest_monthly, backtest_monthly_unadjusted, events, trigger_follow_up, trigger_placebo
from .features import rounded
from .generations import generation_summary_ci


def round_doubles(df, digits=6):
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema])


def _features(spark, sf, grain="card"):
    return bench_for(spark, sf, grain).customer_features


def _labelled(spark, sf, grain="card"):
    """Features with the market segment as given label."""
    return _features(spark, sf, grain).join(adapter.market_segments(spark, sf, grain), "customer_id")


def _numbered(spark, sf):
    return segments.order_by_spend(_labelled(spark, sf), "segment_name")


def _banded(spark, sf):
    return generations.with_buckets(_labelled(spark, sf), bench_for(spark, sf, "card").cuts)


def segment_numbers(spark, sf):
    return _numbered(spark, sf).select("customer_id", "segment_name", "segment_id")


def segment_profile(spark, sf):
    return round_doubles(segments.profile(_numbered(spark, sf)))


def segment_index(spark, sf):
    return round_doubles(segments.index_matrix(_labelled(spark, sf), "segment_name"))


def top_categories(spark, sf):
    return round_doubles(segments.top_categories(_labelled(spark, sf), "segment_name"))


def ari(spark, sf):
    """Market segment and age band against generation, and generation against itself."""
    labels = F.array(*[F.struct(F.lit(c).alias("labeling"), F.col(c).alias("a"), F.col("generation").alias("b"))
                       for c in ("segment_name", "age_band", "generation")])
    return rounded(stats.adjusted_rand(_banded(spark, sf).select(F.inline(labels)), "a", "b", ("labeling",)), "ari")


def targeting_scores(spark, sf):
    return round_doubles(targeting.score_segments(_labelled(spark, sf)))


def targeting_top(spark, sf):
    return rounded(targeting.top_segments(targeting.score_segments(_labelled(spark, sf))), "score")


def best_of_the_others(spark, sf):
    return round_doubles(targeting.best_of_the_others(targeting.score_segments(_labelled(spark, sf))))


def segment_plays(spark, sf):
    labelled = _labelled(spark, sf, "account")
    fired = backtest.by_segment(events(spark, sf), adapter.market_segments(spark, sf, "account"))
    plays = targeting.segment_plays(segments.profile(labelled, "segment_name", "segment_name"),
                                    targeting.score_segments(labelled), fired)
    return round_doubles(plays)


def trigger_plays(spark, sf):
    panel = bench_for(spark, sf, "account").customer_month
    fired = events(spark, sf)
    out = targeting.trigger_plays(backtest.summary(fired, panel), backtest.holdout_design(fired, panel), RULES)
    return rounded(out, "min_detectable_lift_pct")


def report_wallet(spark, sf):
    return round_doubles(report.wallet_medians(generations.summary(_features(spark, sf))))


def report_birth_year(spark, sf):
    return rounded(report.birth_year_steps(_features(spark, sf)), "late_night_share")


def report_band_levels(spark, sf):
    return rounded(report.band_levels(_banded(spark, sf)), "late_night_share")


def report_seasonality(spark, sf):
    return report.seasonality(backtest_monthly(spark, sf), backtest_monthly_unadjusted(spark, sf))


def report_live_months(spark, sf):
    return report.live_months(backtest_monthly(spark, sf))


def report_category_group(spark, sf):
    return report.category_groups(bench_for(spark, sf, "card").transactions)


def report_overview(spark, sf):
    return report.overview(bench_for(spark, sf, "card").raw)


def report_frequency_tiers(spark, sf):
    return report.frequency_tiers(_features(spark, sf, "account"))


def report_customer_trace(spark, sf):
    return report.customer_trace(bench_for(spark, sf, "card").customer_quarter)


def report_crosstab(spark, sf):
    return segments.crosstab(_banded(spark, sf), "segment_name", "age_band")


def report_crosstab_gender(spark, sf):
    return segments.crosstab(_labelled(spark, sf), "segment_name", "gender")


def report_headlines(spark, sf):
    return report.headlines(_features(spark, sf))


def report_placebo_ratio(spark, sf):
    return rounded(report.mean_placebo_ratio(trigger_placebo(spark, sf)), "mean_placebo_ratio")


def report_effects(spark, sf):
    tests = generations.test_battery(_banded(spark, sf))
    return round_doubles(report.chart_table(tests, "effect_sizes"))


def report_targeting(spark, sf):
    return report.chart_table(targeting_scores(spark, sf), "targeting")


def report_size_vs_spend(spark, sf):
    return report.chart_table(segment_profile(spark, sf), "size_vs_spend")


def report_generation_mix(spark, sf):
    return report.chart_table(segment_profile(spark, sf), "generation_mix")


def report_placebo(spark, sf):
    return report.chart_table(trigger_placebo(spark, sf), "placebo")


def report_generation_bars(spark, sf):
    return report.generation_bars(generation_summary_ci(spark, sf))


def report_follow_up(spark, sf):
    return report.chart_table(trigger_follow_up(spark, sf), "follow_up")


QUERIES = {f.__name__: f for f in (
    segment_numbers, segment_profile, segment_index, top_categories, ari, targeting_scores, targeting_top,
    best_of_the_others, segment_plays, trigger_plays, report_wallet, report_birth_year, report_band_levels,
    report_seasonality, report_live_months, report_category_group, report_overview, report_frequency_tiers,
    report_customer_trace, report_crosstab, report_crosstab_gender, report_headlines, report_placebo_ratio,
    report_effects, report_targeting, report_size_vs_spend, report_generation_mix, report_placebo, report_follow_up,
    report_generation_bars)}
