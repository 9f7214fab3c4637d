"""Triggers and backtest at account grain (first travel at card grain).

The dining floor is 2 here: pooled accounts make about 1.3 dining transactions a month.
"""
from __future__ import annotations


from ..config import TriggerRules
from ..operators import backtest, triggers
from ..plans.workbench import bench_for
from ..sources import adapter
from .features import rounded

RULES = TriggerRules(dining_min_base=2)
PLAIN = RULES.override(portfolio_adjust=0)
FOLLOW_UP_SEGMENT = "BUILDING"


def _panel(spark, sf):
    return bench_for(spark, sf, "account").customer_month


def events(spark, sf, rules=RULES):
    return bench_for(spark, sf, "account").events(rules)


def labels(spark, sf, grain="account"):
    return adapter.market_segments(spark, sf, grain)


def portfolio_month(spark, sf):
    return triggers.portfolio_month(_panel(spark, sf))


def trigger_travel_drop(spark, sf):
    panel = _panel(spark, sf)
    return triggers.travel_drop(panel, triggers.portfolio_month(panel), RULES)


def trigger_dining_cooling(spark, sf):
    panel = _panel(spark, sf)
    return triggers.dining_cooling(panel, triggers.portfolio_month(panel), RULES)


def trigger_first_travel(spark, sf):
    return triggers.first_travel(bench_for(spark, sf, "card").customer_month, RULES)


def trigger_events(spark, sf):
    return events(spark, sf)


def trigger_events_unadjusted(spark, sf):
    return events(spark, sf, PLAIN)


def backtest_monthly(spark, sf):
    return backtest.monthly(events(spark, sf), _panel(spark, sf))


def backtest_monthly_unadjusted(spark, sf):
    return backtest.monthly(events(spark, sf, PLAIN), _panel(spark, sf))


def trigger_summary(spark, sf):
    return rounded(backtest.summary(events(spark, sf), _panel(spark, sf)), "median_stake_per_fire")


def trigger_overlap(spark, sf):
    return backtest.overlap(events(spark, sf))


def deseasonalised_panel(spark, sf):
    return backtest.deseasonalise(_panel(spark, sf))


def trigger_placebo(spark, sf):
    return backtest.placebo(_panel(spark, sf), RULES)


def trigger_follow_up(spark, sf):
    out = backtest.follow_up_with_segment(events(spark, sf), _panel(spark, sf), labels(spark, sf), FOLLOW_UP_SEGMENT)
    return rounded(out, "trigger_period_index", "follow_up_index", "long_run_index", "share_of_drop_recovered_unaided")


def trigger_holdout(spark, sf):
    out = backtest.holdout_design(events(spark, sf), _panel(spark, sf))
    return rounded(out, "outcome_mean", "outcome_sd", "min_detectable_lift_abs", "min_detectable_lift_pct")


def trigger_by_segment(spark, sf):
    return backtest.by_segment(events(spark, sf), labels(spark, sf))


def trigger_sensitivity(spark, sf):
    return backtest.sensitivity(_panel(spark, sf))


QUERIES = {f.__name__: f for f in (
    portfolio_month, trigger_travel_drop, trigger_dining_cooling, trigger_first_travel, trigger_events,
    trigger_events_unadjusted, backtest_monthly, backtest_monthly_unadjusted, trigger_summary, trigger_overlap,
    deseasonalised_panel, trigger_placebo, trigger_follow_up, trigger_holdout, trigger_by_segment,
    trigger_sensitivity)}
