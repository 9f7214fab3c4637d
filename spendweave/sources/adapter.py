"""Shape the shared order tables into card transactions.

Two grains of customer: ``card`` (one per ordering customer) and ``account`` (37 neighbouring customers pooled, which
gives enough activity per month for the drop triggers).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# l_partkey modulo 14 picks the category in this order.
CATEGORY_BY_PART = ("travel", "food_dining", "entertainment", "grocery_pos", "grocery_net", "gas_transport",
                    "shopping_pos", "shopping_net", "health_fitness", "personal_care", "home", "kids_pets",
                    "misc_pos", "misc_net")
CITY_BASE = (1_000, 10_000, 100_000, 500_000)
ACCOUNT_WIDTH = 37


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_key(custkey: str, grain: str):
    if grain == "card":
        return F.col(custkey)
    if grain == "account":
        return F.expr(f"{custkey} div {ACCOUNT_WIDTH}")
    raise ValueError(f"unknown grain {grain!r}")


def raw_transactions(spark: SparkSession, sf_dir: str, grain: str = "card") -> DataFrame:
    """One row per order line in the canonical transaction schema."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    key = customer_key("o_custkey", grain)
    hour = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5) % 24).cast("int")
    categories = F.array(*[F.lit(c) for c in CATEGORY_BY_PART])
    city = F.array(*[F.lit(c).cast("long") for c in CITY_BASE])
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), "part1")
         .otherwise("part2").alias("source_file"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trans_num"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hour)).alias("trans_ts"),
        key.alias("cc_num"),
        F.get(categories, (F.col("l_partkey") % 14).cast("int")).alias("category"),
        (F.col("l_extendedprice") / 100).alias("amt"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        (F.get(city, (key % 4).cast("int")) + key % 997).alias("city_pop"),
        F.date_add(F.lit("1924-01-01").cast("date"), (key * 7919 % 29900).cast("int")).alias("dob"),
        F.when((F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 200 == 0, 1).otherwise(0).alias("is_fraud"),
    )


def market_segments(spark: SparkSession, sf_dir: str, grain: str = "card") -> DataFrame:
    """A given label per customer (customer_id, segment_name), to profile and score without a fitted model."""
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (customer.groupBy(customer_key("c_custkey", grain).alias("customer_id"))
            .agg(F.min_by("c_mktsegment", "c_custkey").alias("segment_name")))
