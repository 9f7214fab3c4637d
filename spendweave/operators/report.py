"""The tables behind the charts and the notebook. Drawing is not part of the engine."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import columns as C
from .quantiles import exact_quantiles, quantile_name

BAR_METRICS = ("online_share", "monthly_txns", "median_ticket")


def wallet_medians(summary: DataFrame) -> DataFrame:
    """Median wallet share, generation by category group."""
    return (summary.filter(F.col("metric").isin(*config.SHARE_COLUMNS))
            .groupBy("generation").pivot("metric", list(config.SHARE_COLUMNS)).agg(F.first("median")))


def generation_bars(summary_with_ci: DataFrame) -> DataFrame:
    return (summary_with_ci.filter(F.col("metric").isin(*BAR_METRICS))
            .select("generation", "n_customers", "metric", "median", "median_ci_low", "median_ci_high"))


def birth_year_steps(features: DataFrame) -> DataFrame:
    return features.groupBy("birth_year").agg(
        F.count("*").alias("customers"), F.avg("late_night_share").alias("late_night_share"))


def band_levels(banded: DataFrame) -> DataFrame:
    return banded.groupBy("age_band").agg(
        F.min("birth_year").alias("first_birth_year"), F.max("birth_year").alias("last_birth_year"),
        F.avg("late_night_share").alias("late_night_share"))


def seasonality(adjusted: DataFrame, unadjusted: DataFrame, trigger: str = "dining_cooling") -> DataFrame:
    """Firing series with and without portfolio adjustment; the first peak of the unadjusted one is marked."""
    def series(monthly, name):
        return monthly.filter(F.col("trigger_name") == trigger).select("month", F.col("customers_firing").alias(name))
    joined = series(adjusted, "portfolio_adjusted").join(series(unadjusted, "unadjusted"), "month")
    place = F.row_number().over(Window.orderBy(F.desc("unadjusted"), "month"))   # one row per month
    return joined.withColumn("is_peak", place == 1)


def live_months(monthly: DataFrame) -> DataFrame:
    """Median customers firing over the months in which a trigger fired at all."""
    live = monthly.filter(F.col("customers_firing") > 0)
    return live.groupBy("trigger_name").agg(F.median("customers_firing").alias("median_customers_firing"))


def category_groups(transactions: DataFrame) -> DataFrame:
    sums = transactions.groupBy("category_group").agg(F.count("*").alias("txns"), C.money_sum("amt").alias("s"))
    medians = exact_quantiles(transactions, ["category_group"], "amt", [0.5])
    total = C.money(F.sum("s").over(Window.partitionBy()))
    return (sums.withColumn("pct_of_spend", F.round(100 * F.col("s") / total, 1))
            .join(F.broadcast(medians), "category_group")
            .select("category_group", "txns", F.round("s").alias("spend"), "pct_of_spend",
                    F.round(F.col("s") / F.col("txns"), 2).alias("avg_ticket"),
                    F.round(quantile_name(0.5), 2).alias("median_ticket")))


def overview(raw: DataFrame) -> DataFrame:
    """Raw and clean volume in one row. Rows are summed up by card first, so cards are counted without a distinct count."""
    clean = F.col("is_fraud") == 0
    by_card = raw.groupBy("cc_num").agg(
        F.count("*").alias("rows"), F.sum("is_fraud").alias("flagged"), F.min("trans_ts").alias("first_ts"),
        F.max("trans_ts").alias("last_ts"), F.count_if(clean).alias("clean_rows"),
        F.sum(F.when(clean, F.col("amt"))).alias("spend"))
    return by_card.agg(
        F.sum("rows").alias("raw_rows"), F.sum("flagged").alias("fraud_rows"), F.count("cc_num").alias("cards"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("clean_rows").alias("clean_rows"),
        F.count_if(F.col("cc_num").isNotNull() & (F.col("clean_rows") > 0)).alias("clean_customers"), C.money_sum("spend").alias("clean_spend"))


def frequency_tiers(features: DataFrame) -> DataFrame:
    return features.groupBy(C.txns_per_day_tier().alias("txns_per_day_tier")).agg(
        F.count("*").alias("customers"), F.min("n_txns").alias("min_txns"), F.max("n_txns").alias("max_txns"))


def customer_trace(quarters: DataFrame, customer_id: int | None = None) -> DataFrame:
    """Quarterly trend of one customer, by default the one with the lowest id."""
    if customer_id is None:
        lowest = quarters.agg(F.min("customer_id").alias("customer_id"))
        rows = quarters.join(F.broadcast(lowest), "customer_id", "left_semi")
    else:
        rows = quarters.filter(F.col("customer_id") == customer_id)
    return rows.select("quarter", F.round("spend").alias("spend"), F.round("prev_q_spend").alias("prev_q_spend"),
                       F.round("qoq_spend_change", 3).alias("qoq_change"),
                       F.round("yoy_spend_change", 3).alias("yoy_change"))


def headlines(features: DataFrame) -> DataFrame:
    """Customers, transactions and customers per generation in one row."""
    return features.agg(
        F.count("*").alias("customers"), F.sum("n_txns").alias("transactions"),
        F.min("recency_days").alias("min_recency"), F.max("recency_days").alias("max_recency"),
        F.max("active_months").alias("max_active_months"),
        *[F.count_if(F.col("generation") == g).alias(g) for g in config.GENERATIONS])


def mean_placebo_ratio(placebo: DataFrame) -> DataFrame:
    return placebo.agg(F.avg("actual_to_placebo_ratio").alias("mean_placebo_ratio"))


# chart -> columns of the result table behind it
CHART_COLUMNS = {
    "effect_sizes": ("metric", "test", "effect_measure", "effect_size", "effect_within_age_band", "p_holm"),
    "size_vs_spend": ("segment_name", "n_customers", "customer_share", "spend_share"),
    "generation_mix": ("segment_name", *(f"gen_{g}" for g in config.GENERATIONS)),
    "targeting": ("benefit_label", "rank", "segment_name", "n_customers", "engagement", "headroom", "value", "score",
                  "category_share_of_wallet", "category_monthly_spend"),
    "k_selection": ("k", "inertia", "silhouette", "silhouette_squared", "bootstrap_ari_mean", "bootstrap_ari_p05",
                    "gmm_bic", "gmm_vs_kmeans_ari", "inertia_drop_pct"),
    "placebo": ("trigger_name", "actual_fires", "placebo_fires_mean", "placebo_fires_min", "placebo_fires_max",
                "actual_to_placebo_ratio"),
    "follow_up": ("scope", "trigger_name", "trigger_period_index", "follow_up_index", "long_run_index",
                  "share_of_drop_recovered_unaided"),
}


def chart_table(table: DataFrame, chart: str) -> DataFrame:
    return table.select(*CHART_COLUMNS[chart])
