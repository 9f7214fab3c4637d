"""The customer feature table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import columns as C

FEATURE_COLUMNS = (
    "customer_id", "generation", "birth_year", "age_at_end", "gender", "city_pop", "city_size_band",
    "recency_days", "active_months", "n_txns", "total_spend", "monthly_txns", "monthly_spend", "avg_ticket",
    "median_ticket", *config.SHARE_COLUMNS, "online_share", "weekend_share", "late_night_share", "spend_volatility",
    "avg_qoq_spend_change", "last_qoq_spend_change", "avg_yoy_spend_change", "monthly_travel_spend",
    "monthly_dining_spend", "monthly_dining_txns", "txns_travel", "txns_travel_100plus", "dining_active_month_share",
    "travel_active_month_share", "travel_active_year_share")


def from_panel(panel: DataFrame) -> DataFrame:
    """Recency, frequency, value, wallet, channel and timing per customer, regrouped from the month rows."""
    months = F.count("*")
    sums = panel.groupBy("customer_id").agg(
        F.sum("txns").alias("n_txns"),
        C.money_sum("spend").alias("total_spend"),
        F.max("last_txn_date").alias("last_txn_date"),
        (C.month_number(F.max("month")) - C.month_number(F.min("month")) + 1).alias("active_months"),
        *[C.money_sum(f"spend_{g}").alias(f"spend_{g}") for g in config.CATEGORY_GROUPS],
        C.money_sum("spend_online").alias("spend_online"),
        C.money_sum("spend_tagged").alias("spend_tagged"),
        F.sum("weekend_txns").alias("weekend_txns"),
        F.sum("late_night_txns").alias("late_night_txns"),
        C.money_sum("dining_spend").alias("dining_spend"),
        F.sum("dining_txns").alias("dining_txns"),
        F.sum("travel_txns").alias("txns_travel"),
        F.sum("travel_100plus_txns").alias("txns_travel_100plus"),
        F.stddev_samp("spend").alias("spend_sd"),
        months.alias("panel_months"),
        (F.count_if(F.col("dining_txns") > 0) / months).alias("dining_active_month_share"),
        (F.count_if(F.col("travel_txns") > 0) / months).alias("travel_active_month_share"),
        (F.sum("opens_travel_year") / F.sum("opens_year")).alias("travel_active_year_share"),
    )
    per_month = lambda c: F.col(c) / F.col("active_months")
    mean_month = F.col("total_spend") / F.col("panel_months")
    return sums.select(
        "customer_id", "last_txn_date", "active_months", "n_txns", "total_spend",
        per_month("n_txns").alias("monthly_txns"),
        per_month("total_spend").alias("monthly_spend"),
        (F.col("total_spend") / F.col("n_txns")).alias("avg_ticket"),
        *[C.ratio(f"spend_{g}", "total_spend").alias(f"share_{g}") for g in config.CATEGORY_GROUPS],
        C.coalesce0(C.ratio("spend_online", "spend_tagged")).alias("online_share"),
        (F.col("weekend_txns") / F.col("n_txns")).alias("weekend_share"),
        (F.col("late_night_txns") / F.col("n_txns")).alias("late_night_share"),
        C.coalesce0(C.ratio("spend_sd", mean_month)).alias("spend_volatility"),
        per_month("spend_travel").alias("monthly_travel_spend"),
        per_month("dining_spend").alias("monthly_dining_spend"),
        per_month("dining_txns").alias("monthly_dining_txns"),
        "txns_travel", "txns_travel_100plus", "dining_active_month_share", "travel_active_month_share",
        "travel_active_year_share")


def from_quarters(quarters: DataFrame) -> DataFrame:
    """Trend per customer; the last change skips quarters without one."""
    return quarters.groupBy("customer_id").agg(
        F.avg("qoq_spend_change").alias("avg_qoq_spend_change"),
        F.max_by("qoq_spend_change", F.when(F.col("qoq_spend_change").isNotNull(), F.col("quarter")))
         .alias("last_qoq_spend_change"),
        F.avg("yoy_spend_change").alias("avg_yoy_spend_change"))


def customer_features(customers: DataFrame, panel: DataFrame, quarters: DataFrame, medians: DataFrame) -> DataFrame:
    """38 columns per customer. ``panel`` carries all month facts, ``medians`` has customer_id and median_ticket."""
    data_end = F.broadcast(panel.agg(F.max("last_txn_date").alias("data_end")))
    joined = (from_panel(panel)
              .join(from_quarters(quarters), "customer_id")
              .join(medians, "customer_id")
              .join(customers, "customer_id")
              .crossJoin(data_end))
    return (joined.withColumn("recency_days", F.date_diff("data_end", "last_txn_date").cast("long"))
            .select(*FEATURE_COLUMNS))
