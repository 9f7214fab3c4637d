"""The three behaviour triggers.

Every rule runs on windows keyed by the customer (or by a replicate or rule variant within the customer), so one
exchange by customer serves all of them. Thresholds arrive as columns: literals for a single run, fields of a variant
when many rule sets are evaluated at once.
"""
from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..config import TriggerRules
from ..functions import columns as C

EVENT_COLUMNS = ("customer_id", "month", "trigger_name", "baseline_value", "current_value", "spend_at_stake")
ALL_CUSTOMERS = ("customer_id",)


def portfolio_month(panel: DataFrame) -> DataFrame:
    """Portfolio totals per calendar month: one row per month, so always small enough to broadcast."""
    return panel.groupBy("month").agg(
        C.money_sum("travel_spend").alias("travel_spend"),
        C.money_sum("dining_spend").alias("dining_spend"),
        F.sum("dining_txns").alias("dining_txns"))


def rule_columns(rules: TriggerRules) -> dict[str, Column]:
    return {name: F.lit(value) for name, value in asdict(rules).items()}


def _history(keys, order="month"):
    return Window.partitionBy(*keys).orderBy(order)


def _fire(candidates: DataFrame, keys, cooldown: Column, order: str = "month_idx") -> DataFrame:
    """Keep in-state rows whose last earlier in-state row lies more than ``cooldown`` positions back.

    A persisting state keeps extending the silence, because states count here and not fires. Only in-state rows matter,
    so all others are gone before the window sorts anything.
    """
    inside = candidates.filter("in_state")
    return (inside.withColumn("last_state_idx", F.lag("month_idx").over(_history(keys, order)))
            .filter(F.col("last_state_idx").isNull()
                    | (F.col("month_idx") - F.col("last_state_idx") > cooldown)))


def _candidates(windows: DataFrame, columns, candidates) -> DataFrame:
    """One row per panel row and candidate; a candidate is a struct with trigger_name and in_state."""
    return windows.select(*columns, F.inline(F.array(*candidates)))


# --- travel drop -----------------------------------------------------------

def travel_windows(panel: DataFrame, portfolio: DataFrame | None, keys=ALL_CUSTOMERS,
                   order: str = "month") -> DataFrame:
    """Last three months against the three before, plus the portfolio's ratio over the same months."""
    history = _history(keys, order)
    out = (panel
           .withColumn("cur_3m", C.money(F.sum("travel_spend").over(history.rowsBetween(-2, 0))))
           .withColumn("prior_3m", F.lag("cur_3m", 3).over(history)))
    if portfolio is None:
        return out.withColumn("portfolio_ratio", F.lit(1.0))
    by_month = Window.orderBy("month")           # one row per calendar month
    ratio = (portfolio
             .withColumn("cur", C.money(F.sum("travel_spend").over(by_month.rowsBetween(-2, 0))))
             .select("month", C.ratio("cur", F.lag("cur", 3).over(by_month)).alias("portfolio_ratio")))
    return out.join(F.broadcast(ratio), "month")


def expected_travel(rule: dict[str, Column]) -> Column:
    ratio = F.when(rule["portfolio_adjust"] == 1, F.coalesce("portfolio_ratio", F.lit(1.0))).otherwise(F.lit(1.0))
    return F.col("prior_3m") * ratio


def travel_state(rule: dict[str, Column]) -> Column:
    return ((F.col("month_idx") >= 6) & (F.col("prior_3m") >= rule["travel_min_base"])
            & (F.col("cur_3m") < (1 - rule["travel_drop_pct"]) * expected_travel(rule)))


def _candidate(trigger: str, state: Column, *rest: Column) -> Column:
    return F.struct(F.lit(trigger).alias("trigger_name"), state.alias("in_state"), *rest)


def _valued(trigger: str, state: Column, baseline: Column, current: Column, stake: Column) -> Column:
    return _candidate(trigger, state, baseline.alias("baseline_value"), current.alias("current_value"),
                      stake.alias("spend_at_stake"))


def _travel_candidate(rule):
    return _valued("travel_drop", travel_state(rule), F.col("prior_3m"), F.col("cur_3m"),
                   expected_travel(rule) - F.col("cur_3m"))


# --- first travel ----------------------------------------------------------

def first_travel_window(panel: DataFrame) -> DataFrame:
    """Position of each customer's first month with travel, found by a window instead of a self join."""
    everything = Window.partitionBy("customer_id")
    return panel.withColumn("first_idx", F.min(F.when(F.col("travel_txns") > 0, F.col("month_idx"))).over(everything))


def first_travel_state(rule: dict[str, Column]) -> Column:
    return (F.col("month_idx") == F.col("first_idx")) & (F.col("first_idx") > rule["first_travel_min_history"])


def _first_candidate(rule):
    return _valued("first_travel", first_travel_state(rule), F.lit(0.0), F.col("travel_spend"), F.col("travel_spend"))


# --- dining cooling --------------------------------------------------------

def dining_windows(panel: DataFrame, portfolio: DataFrame | None, keys=ALL_CUSTOMERS,
                   order: str = "month") -> DataFrame:
    """Counts of this month and the two before, raw and as a share of the portfolio."""
    history = _history(keys, order)
    if portfolio is None:
        base = panel.withColumn("port_txns", F.lit(1)).withColumn("port_spend", F.lit(1.0))
    else:
        totals = portfolio.select("month", F.col("dining_txns").alias("port_txns"),
                                  F.col("dining_spend").alias("port_spend"))
        base = panel.join(F.broadcast(totals), "month")
    base = base.withColumn("share_txns", C.ratio("dining_txns", "port_txns"))
    for lag in (1, 2):
        base = base.withColumn(f"txns_{lag}", F.lag("dining_txns", lag).over(history))
        base = base.withColumn(f"share_{lag}", F.lag("share_txns", lag).over(history))
    return (base.withColumn("base_spend", F.lag("dining_spend", 2).over(history))
            .withColumn("base_port_spend", F.lag("port_spend", 2).over(history)))


def dining_state(rule: dict[str, Column]) -> Column:
    adjust = rule["portfolio_adjust"] == 1

    def pick(share, count):
        return F.when(adjust, F.col(share)).otherwise(F.col(count).cast("double"))

    now, one, two = pick("share_txns", "dining_txns"), pick("share_1", "txns_1"), pick("share_2", "txns_2")
    return ((F.col("month_idx") >= 3) & (now < one) & (one < two) & (F.col("txns_2") >= rule["dining_min_base"])
            & (now <= (1 - rule["dining_min_drop"]) * two))


def _dining_candidate(rule):
    adjust = rule["portfolio_adjust"] == 1
    scale = F.when(adjust, F.col("port_spend")).otherwise(F.lit(1.0))
    base_scale = F.when(adjust, F.col("base_port_spend")).otherwise(F.lit(1.0))
    expected = C.ratio(F.col("base_spend") * scale, base_scale)
    return _valued("dining_cooling", dining_state(rule), F.col("txns_2").cast("double"),
                   F.col("dining_txns").cast("double"), F.greatest(expected - F.col("dining_spend"), F.lit(0.0)))


# --- all -------------------------------------------------------------------

def _events(windows: DataFrame, rule: dict[str, Column], *candidates: Column) -> DataFrame:
    rows = _candidates(windows, ("customer_id", "month", "month_idx"), candidates)
    return _fire(rows, ("customer_id", "trigger_name"), rule["cooldown_months"]).select(*EVENT_COLUMNS)


def travel_drop(panel: DataFrame, portfolio: DataFrame, rules: TriggerRules = TriggerRules()) -> DataFrame:
    rule = rule_columns(rules)
    return _events(travel_windows(panel, portfolio), rule, _travel_candidate(rule))


def first_travel(panel: DataFrame, rules: TriggerRules = TriggerRules()) -> DataFrame:
    rule = rule_columns(rules)
    return _events(first_travel_window(panel), rule, _first_candidate(rule))


def dining_cooling(panel: DataFrame, portfolio: DataFrame, rules: TriggerRules = TriggerRules()) -> DataFrame:
    rule = rule_columns(rules)
    return _events(dining_windows(panel, portfolio), rule, _dining_candidate(rule))


def all_windows(panel: DataFrame, portfolio: DataFrame) -> DataFrame:
    """The windows of all three triggers over one scan and one sort of the panel."""
    return first_travel_window(dining_windows(travel_windows(panel, portfolio), portfolio))


def trigger_events(panel: DataFrame, rules: TriggerRules = TriggerRules(),
                   portfolio: DataFrame | None = None) -> DataFrame:
    """All fires of one rule set, unique by customer, month and trigger."""
    portfolio = portfolio_month(panel) if portfolio is None else portfolio
    rule = rule_columns(rules)
    return _events(all_windows(panel, portfolio), rule, _travel_candidate(rule), _first_candidate(rule),
                   _dining_candidate(rule))


def trigger_states(panel: DataFrame, rules: TriggerRules = TriggerRules(), portfolio: DataFrame | None = None) -> DataFrame:
    """Every month in which a customer is in a trigger's state, before any cooldown: the event columns and month_idx."""
    portfolio = portfolio_month(panel) if portfolio is None else portfolio
    rule = rule_columns(rules)
    rows = _candidates(all_windows(panel, portfolio), ("customer_id", "month", "month_idx"),
                       (_travel_candidate(rule), _first_candidate(rule), _dining_candidate(rule)))
    return rows.filter("in_state").select(*EVENT_COLUMNS, "month_idx")


def ordered(events: DataFrame) -> DataFrame:
    """Total order for presentation."""
    return events.orderBy("month", "trigger_name", "customer_id")


def drop_fires(panel: DataFrame, keys, rules: TriggerRules) -> DataFrame:
    """Unadjusted fires (keys, trigger_name) of the two drop triggers on histories ordered by month_idx."""
    rule = rule_columns(rules.override(portfolio_adjust=0))
    windows = dining_windows(travel_windows(panel, None, keys, "month_idx"), None, keys, "month_idx")
    rows = _candidates(windows, (*keys, "month_idx"), (_candidate("travel_drop", travel_state(rule)),
                                                       _candidate("dining_cooling", dining_state(rule))))
    return _fire(rows, (*keys, "trigger_name"), rule["cooldown_months"]).select(*keys, "trigger_name")


STATES = {"travel_drop": travel_state, "first_travel": first_travel_state, "dining_cooling": dining_state}


def variant_fires(panel: DataFrame, portfolio: DataFrame, variants=config.SENSITIVITY_VARIANTS) -> DataFrame:
    """Fires (variant, trigger_name, customer_id, month, first_fire) of every rule variant in one pass over the panel.

    A customer's first in-state row always fires, so ``first_fire`` marks exactly one fire per customer.
    """
    candidates = []
    for label, (changes, relevant) in variants.items():
        rule = rule_columns(TriggerRules().override(**changes))
        candidates += [_candidate(t, STATES[t](rule), F.lit(label).alias("variant"),
                                  rule["cooldown_months"].alias("cooldown")) for t in relevant]
    rows = _candidates(all_windows(panel, portfolio), ("customer_id", "month", "month_idx"), candidates)
    fires = _fire(rows, ("customer_id", "variant", "trigger_name"), F.col("cooldown"))
    return fires.select("variant", "trigger_name", "customer_id", "month",
                        F.col("last_state_idx").isNull().alias("first_fire"))
