"""Segment by benefit score and the tables behind the plays."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..config import TriggerRules
from ..functions import columns as C
from .quantiles import exact_quantiles, quantile_name


def score_segments(customers: DataFrame) -> DataFrame:
    """score = engagement x headroom x value for every segment and benefit.

    ``customers`` needs segment_name, monthly_spend and the benefit columns. Headroom is measured per customer against
    the 90th percentile share of all customers.
    """
    options = F.array(*[F.struct(
        F.lit(key).alias("benefit"), F.lit(label).alias("benefit_label"),
        F.col(engagement).cast("double").alias("engaged"), F.col(spend).cast("double").alias("category_spend"),
    ) for key, (label, engagement, spend) in config.BENEFITS.items()])
    rows = (customers.select("segment_name", F.col("monthly_spend").cast("double").alias("monthly_spend"),
                             F.inline(options))
            .withColumn("share", C.ratio("category_spend", "monthly_spend")))
    q = config.HEADROOM_QUANTILE
    benchmark = (exact_quantiles(rows, ["benefit"], "share", [q])
                 .withColumnRenamed(quantile_name(q), "benchmark"))
    scored = rows.join(F.broadcast(benchmark), "benefit").withColumn("room", C.headroom("share", "benchmark"))
    means = scored.groupBy("benefit", "benefit_label", "segment_name").agg(
        F.count("*").alias("n_customers"), F.avg("engaged").alias("engagement"), F.avg("room").alias("headroom"),
        F.avg("monthly_spend").alias("mean_spend"), F.avg("share").alias("category_share_of_wallet"),
        F.avg("category_spend").alias("category_monthly_spend"), F.max("benchmark").alias("headroom_benchmark_share"))
    benefit = Window.partitionBy("benefit")
    return (means
            .withColumn("value", C.ratio("mean_spend", F.max("mean_spend").over(benefit)))
            .withColumn("score", F.col("engagement") * F.col("headroom") * F.col("value"))
            .withColumn("rank", F.row_number().over(benefit.orderBy(F.desc("score"), "segment_name")).cast("long"))
            .withColumn("score_index", C.ratio("score", F.max("score").over(benefit)) * 100)
            .select("benefit", "benefit_label", "segment_name", "n_customers", "engagement", "headroom", "value",
                    "score", "category_share_of_wallet", "category_monthly_spend", "headroom_benchmark_share", "rank",
                    "score_index"))


def top_segments(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("rank") == 1).select("benefit", "benefit_label", "segment_name", "score")


def best_of_the_others(scores: DataFrame, benefit: str = "dining_credit",
                       value: str = "category_share_of_wallet") -> DataFrame:
    """Largest value among the other segments: the maximum, or the runner-up for the segment that holds it."""
    one = scores.filter(F.col("benefit") == benefit)
    by_value = Window.orderBy(F.desc(value), "segment_name")
    top, second = F.max("v1").over(Window.partitionBy()), F.max("v2").over(Window.partitionBy())
    placed = (one.withColumn("place", F.row_number().over(by_value))
              .withColumn("v1", F.when(F.col("place") == 1, F.col(value)))
              .withColumn("v2", F.when(F.col("place") == 2, F.col(value))))
    return placed.select("segment_name", F.col(value), F.when(F.col("place") == 1, second).otherwise(top)
                         .alias("best_other"))


def segment_plays(profiles: DataFrame, scores: DataFrame, fired: DataFrame) -> DataFrame:
    """Profile, scores of both benefits and trigger reach, one row per segment."""
    def scored(benefit, prefix):
        return F.max(F.when(F.col("benefit") == benefit, F.col("rank"))).alias(f"{prefix}_rank"), F.max(
            F.when(F.col("benefit") == benefit, F.col("score"))).alias(f"{prefix}_score")

    by_benefit = scores.groupBy("segment_name").agg(*scored("dining_credit", "dining"),
                                                    *scored("travel_credit", "travel"))
    reach = fired.groupBy("segment_name").agg(
        *[C.coalesce0(F.max(F.when(F.col("trigger_name") == t, F.col("customers"))), "long").alias(f"{t}_customers")
          for t in config.TRIGGERS],
        *[C.coalesce0(F.max(F.when(F.col("trigger_name") == t, F.col("spend_at_stake")))).alias(f"{t}_stake")
          for t in config.TRIGGERS])
    others = best_of_the_others(scores).select(
        "segment_name", F.col("category_share_of_wallet").alias("dining_share"),
        F.col("best_other").alias("dining_share_elsewhere"))
    columns = ("segment_name", "n_customers", "customer_share", "monthly_spend", "monthly_txns", "share_travel",
               "online_share")
    return (profiles.select(*columns)
            .join(by_benefit, "segment_name").join(others, "segment_name").join(reach, "segment_name", "left"))


def trigger_plays(summary: DataFrame, holdout: DataFrame, rules: TriggerRules = TriggerRules()) -> DataFrame:
    """Backtest volume, holdout size and the thresholds that apply, one row per trigger."""
    def when(trigger, value):
        return F.when(F.col("trigger_name") == trigger, F.lit(value))
    label = F.coalesce(*[when(t, text) for t, text in config.TRIGGER_LABELS.items()])
    sizes = holdout.select("trigger_name", "fires_per_year", "holdout", "min_detectable_lift_pct",
                           "fires_needed_for_10pct_lift")
    return summary.join(sizes, "trigger_name", "left").select(
        "trigger_name", label.alias("trigger"), "fires", "customers", "pct_customers_ever_firing", "spend_at_stake",
        F.coalesce(when("travel_drop", rules.travel_drop_pct), when("dining_cooling", rules.dining_min_drop))
         .alias("drop_share"),
        F.coalesce(when("travel_drop", float(rules.travel_min_base)),
                   when("dining_cooling", float(rules.dining_min_base))).alias("min_base"),
        when("first_travel", rules.first_travel_min_history).cast("long").alias("min_history"),
        "fires_per_year", "holdout", "min_detectable_lift_pct", "fires_needed_for_10pct_lift")
