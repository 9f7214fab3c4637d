"""Customer by month panel and customer by quarter trends."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import columns as C

PANEL_COLUMNS = ("customer_id", "month", "month_idx", "txns", "spend", "travel_spend", "travel_txns", "dining_spend",
                 "dining_txns")


def month_facts(transactions: DataFrame) -> DataFrame:
    """Everything later steps need per customer and month, in one pass.

    Combines map side, so a customer that holds a large part of all rows sends at most one row per month and task.
    """
    def spend(condition):
        return C.coalesce0(C.money_sum(F.when(condition, F.col("amt"))))

    travel, dining = F.col("category") == "travel", F.col("category") == "food_dining"
    return transactions.groupBy("customer_id", "month").agg(
        F.count("*").alias("txns"),
        C.money_sum("amt").alias("spend"),
        spend(travel).alias("travel_spend"),
        F.count_if(travel).alias("travel_txns"),
        spend(dining).alias("dining_spend"),
        F.count_if(dining).alias("dining_txns"),
        *[spend(F.col("category_group") == g).alias(f"spend_{g}") for g in config.CATEGORY_GROUPS],
        spend(F.col("channel") == "online").alias("spend_online"),
        spend(F.col("channel").isin("online", "in_store")).alias("spend_tagged"),
        F.count_if("is_weekend").alias("weekend_txns"),
        F.count_if("is_late_night").alias("late_night_txns"),
        F.count_if(travel & (F.col("amt") >= 100)).alias("travel_100plus_txns"),
        F.max("trans_date").alias("last_txn_date"),
    )


def months_present(facts: DataFrame) -> DataFrame:
    """Calendar months that occur in the data (month facts, or transactions): twelve rows a year at most."""
    return facts.select("month").distinct()


def fill_months(facts: DataFrame, months: DataFrame) -> DataFrame:
    """Zero rows for the silent months between a customer's first and last month.

    Each row generates the gap up to the customer's next active month. That needs one window over the facts instead of
    a range join of tenures with the calendar. Months in which nobody transacted stay out. The same window marks the
    first active month of each calendar year and the first with a larger travel purchase, so that years can later be
    counted by summing. A customer's months are numbered by their places in the calendar, so the filled rows aren't sorted.
    """
    by_customer = Window.partitionBy("customer_id").orderBy("month")
    places = F.broadcast(months.select("month", F.row_number().over(Window.orderBy("month")).cast("long").alias("place")))
    earlier = by_customer.rowsBetween(Window.unboundedPreceding, -1)
    large_travel = F.col("travel_100plus_txns") > 0

    def opens_year(last):
        return (last.isNull() | (F.year(last) != F.year("month"))).cast("int")

    values = [c for c in facts.columns if c not in ("customer_id", "month")] + ["opens_year", "opens_travel_year"]
    facts = (facts.join(places, "month")
             .withColumn("first_place", F.min("place").over(by_customer)).drop("place")
             .withColumn("opens_year", opens_year(F.lag("month").over(by_customer)))
             .withColumn("opens_travel_year", F.when(large_travel, opens_year(
                 F.max(F.when(large_travel, F.col("month"))).over(earlier))).otherwise(0)))
    gap_end = F.coalesce(F.add_months(F.lead("month").over(by_customer), -1), F.col("month"))
    spread = (facts.withColumn("gap_end", gap_end)
              .withColumn("calendar", F.explode(F.sequence("month", "gap_end", F.expr("interval 1 month")))))
    active = F.col("calendar") == F.col("month")

    def keep(name):
        value = F.when(active, F.col(name))
        return (value if name == "last_txn_date" else value.otherwise(F.lit(0))).alias(name)

    filled = spread.select("customer_id", F.col("calendar").alias("month"), "first_place", *[keep(c) for c in values])
    present = filled.join(places, "month")
    return present.select(
        "customer_id", "month", (F.col("place") - F.col("first_place") + 1).alias("month_idx"), *values)


def customer_quarter(panel: DataFrame) -> DataFrame:
    """Quarter sums with the change on the previous quarter and on the same quarter a year before."""
    by_customer = Window.partitionBy("customer_id").orderBy("quarter")
    sums = panel.groupBy("customer_id", C.quarter_of("month").alias("quarter")).agg(
        C.money_sum("spend").alias("spend"), F.sum("txns").alias("txns"),
        C.money_sum("travel_spend").alias("travel_spend"), C.money_sum("dining_spend").alias("dining_spend"))
    return (sums
            .withColumn("prev_q_spend", F.lag("spend", 1).over(by_customer))
            .withColumn("prev_y_spend", F.lag("spend", 4).over(by_customer))
            .withColumn("prev_q_travel_spend", F.lag("travel_spend", 1).over(by_customer))
            .withColumn("qoq_spend_change", C.growth("spend", "prev_q_spend"))
            .withColumn("yoy_spend_change", C.growth("spend", "prev_y_spend"))
            .withColumn("qoq_travel_change", C.growth("travel_spend", "prev_q_travel_spend")))
