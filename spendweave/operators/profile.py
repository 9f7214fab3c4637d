"""Data profile: what is in the sources, transactions, features and panel."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .quantiles import exact_quantiles, quantile_name


def whole():
    """Window over everything. Only used on aggregates with a handful of rows."""
    return Window.partitionBy()


def share_of_total(c, exact: bool = True):
    """``exact`` is for counts; money totals are trimmed to the money digits."""
    total = F.sum(c).over(whole())
    return C.ratio(c, total if exact else C.money(total))


def sources(raw: DataFrame) -> DataFrame:
    return raw.groupBy(F.col("source_file").alias("file")).agg(
        F.count("*").alias("rows"), F.min("trans_ts").alias("first_ts"), F.max("trans_ts").alias("last_ts"),
        F.sum("is_fraud").alias("fraud_rows"))


def totals(raw: DataFrame) -> DataFrame:
    """One row. Cards are counted as groups; the transaction numbers are the only distinct count."""
    holes = F.col("amt").isNull() | F.col("category").isNull() | F.col("dob").isNull()
    by_card = raw.groupBy("cc_num").agg(
        F.count("*").alias("n"), F.sum("is_fraud").alias("flagged"), F.min("trans_ts").alias("first_ts"),
        F.max("trans_ts").alias("last_ts"), F.count_if(holes).alias("holes"))
    sums = by_card.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sum("flagged").alias("fraud_rows"), F.count("cc_num").alias("cards"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.coalesce(F.sum("holes"), F.lit(0)).alias("rows_with_nulls"))
    numbers = raw.agg(F.count_distinct("trans_num").alias("distinct_trans_num"))
    return sums.crossJoin(F.broadcast(numbers)).select(                      # one row each
        "rows", "distinct_trans_num", "fraud_rows", "cards", "first_ts", "last_ts", "rows_with_nulls")


def flagged_only(raw: DataFrame) -> DataFrame:
    """Customers all of whose rows are flagged."""
    return (raw.groupBy("cc_num").agg(F.sum(1 - F.col("is_fraud")).alias("clean"))
            .filter(F.col("clean") == 0).agg(F.count("*").alias("n")))


def consistency(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count("*").alias("customers"), F.count_if("attributes_consistent").alias("consistent"))


def clean_totals(transactions: DataFrame) -> DataFrame:
    by_month = transactions.groupBy("month").agg(F.count("*").alias("n"), C.money_sum("amt").alias("spend"))
    return by_month.agg(F.sum("n").alias("rows"), C.money_sum("spend").alias("spend"), F.count("*").alias("months"))


def categories(transactions: DataFrame) -> DataFrame:
    sums = transactions.groupBy("category", "category_group", "channel").agg(
        F.count("*").alias("txns"), C.money_sum("amt").alias("spend"))
    medians = exact_quantiles(transactions, ["category"], "amt", [0.5])
    return (sums.withColumn("spend_share", share_of_total(F.col("spend"), exact=False))
            .withColumn("avg_ticket", F.col("spend") / F.col("txns"))
            .join(F.broadcast(medians), "category")
            .withColumnRenamed(quantile_name(0.5), "median_ticket"))


def amount_quantiles(transactions: DataFrame) -> DataFrame:
    probabilities = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    quantiles = exact_quantiles(transactions, [], "amt", list(probabilities.values()))
    rest = transactions.agg((C.money_sum("amt") / F.count("amt")).alias("mean"), F.max("amt").alias("max"))
    return quantiles.crossJoin(F.broadcast(rest)).select(
        *[F.col(quantile_name(p)).alias(n) for n, p in probabilities.items()], "mean", "max")


FEATURE_MEASURES = {"Monthly spend ($)": "monthly_spend", "Transactions per month": "monthly_txns",
                    "Average ticket ($)": "avg_ticket", "Recency (days)": "recency_days"}


def stacked(features: DataFrame, measures: dict[str, str], *keys: str) -> DataFrame:
    """One row per customer and measure."""
    pairs = F.array(*[F.struct(F.lit(label).alias("measure"), F.col(c).cast("double").alias("value"))
                      for label, c in measures.items()])
    return features.select(*keys, F.inline(pairs))


def feature_quantiles(features: DataFrame, measures=None) -> DataFrame:
    rows = stacked(features, measures or FEATURE_MEASURES)
    quantiles = exact_quantiles(rows, ["measure"], "value", [0.25, 0.5, 0.75])
    rest = rows.groupBy("measure").agg(
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    return rest.join(F.broadcast(quantiles), "measure").select(
        "measure", "min", F.col(quantile_name(0.25)).alias("p25"), F.col(quantile_name(0.5)).alias("p50"), "mean",
        F.col(quantile_name(0.75)).alias("p75"), "max")


def generations(features: DataFrame) -> DataFrame:
    counts = features.groupBy("generation").agg(
        F.count("*").alias("customers"), F.min("birth_year").alias("first_birth_year"),
        F.max("birth_year").alias("last_birth_year"))
    medians = exact_quantiles(features, ["generation"], "monthly_spend", [0.5])
    return (counts.withColumn("share", share_of_total(F.col("customers")))
            .join(F.broadcast(medians), "generation")
            .withColumnRenamed(quantile_name(0.5), "median_monthly_spend"))


def months(panel: DataFrame) -> DataFrame:
    """Volume per month. The panel has one row per customer and month, so counting rows counts customers."""
    sums = panel.groupBy("month").agg(
        F.sum("txns").alias("txns"), C.money_sum("spend").alias("spend"),
        F.count_if(F.col("txns") > 0).alias("active_customers"))
    average = C.money(F.sum("spend").over(whole())) / F.count("*").over(whole())
    return sums.select(F.date_format("month", "yyyy-MM").alias("month"), "txns", "spend", "active_customers",
                       C.ratio("spend", average).alias("index_vs_avg"))


def tiers(features: DataFrame) -> DataFrame:
    return features.groupBy(C.txns_per_day_tier(half_even=False).alias("txns_per_day_tier")).agg(
        F.count("*").alias("customers"), F.min("n_txns").alias("min_txns"), F.max("n_txns").alias("max_txns"))


def hour_blocks(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy(C.hour_block("trans_ts").alias("block")).agg(
        F.count("*").alias("txns"), (F.count("*") / F.lit(12.0).cast("double")).alias("avg_txns_per_hour"))


def ticket_bands(transactions: DataFrame, category: str = "travel") -> DataFrame:
    sums = (transactions.filter(F.col("category") == category)
            .groupBy(C.ticket_band("amt").alias("ticket"))
            .agg(F.count("*").alias("txns"), C.money_sum("amt").alias("spend")))
    return sums.select("ticket", "txns", share_of_total(F.col("txns")).alias("txn_share"),
                       share_of_total(F.col("spend"), exact=False).alias("spend_share"))


def describe(features: DataFrame, columns) -> DataFrame:
    """Mean, deviation, extremes and exact median of the given columns."""
    rows = stacked(features, {c: c for c in columns})
    medians = exact_quantiles(rows, ["measure"], "value", [0.5])
    rest = rows.groupBy("measure").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    return (rest.join(F.broadcast(medians), "measure", "left")
            .withColumnRenamed(quantile_name(0.5), "median"))
