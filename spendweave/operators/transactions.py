"""Clean transactions and the customer dimension."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def clean(raw: DataFrame) -> DataFrame:
    """Unflagged rows with calendar keys, category group and channel. A narrow projection, no shuffle."""
    return raw.filter(F.col("is_fraud") == 0).select(
        *[c for c in ("trans_num",) if c in raw.columns],
        F.col("cc_num").alias("customer_id"),
        "trans_ts",
        F.to_date("trans_ts").alias("trans_date"),
        C.month_of("trans_ts").alias("month"),
        C.quarter_of("trans_ts").alias("quarter"),
        "category",
        C.category_group("category").alias("category_group"),
        C.channel("category").alias("channel"),
        "amt",
        C.is_weekend("trans_ts").alias("is_weekend"),
        C.is_late_night("trans_ts").alias("is_late_night"),
    )


def last_date(transactions: DataFrame) -> DataFrame:
    """The last day in the data, as one row."""
    return transactions.agg(F.max("trans_date").alias("data_end"))


def customers(raw: DataFrame, data_end: DataFrame) -> DataFrame:
    """One row per customer with bands. ``data_end`` is the one-row result of :func:`last_date`.

    Attribute combinations are counted first. That step combines map side in a hash table and leaves a handful of rows
    per customer for the three distinct counts. The row count is carried along on purpose: all other aggregates ignore
    duplicates, and without it the optimizer would drop the first step and expand the raw rows instead.
    """
    combos = (raw.filter(F.col("is_fraud") == 0)
              .groupBy(F.col("cc_num").alias("customer_id"), "dob", "gender", "city_pop")
              .agg(F.count("*").alias("n_rows")))
    base = combos.groupBy("customer_id").agg(
        F.min("dob").alias("dob"), F.min("gender").alias("gender"), F.min("city_pop").alias("city_pop"),
        (F.count_distinct("dob") + F.count_distinct("gender") + F.count_distinct("city_pop")).alias("n_values"),
        F.sum("n_rows").alias("n_rows")).filter(F.col("n_rows") > 0)
    birth_year = F.year("dob").cast("long")
    return base.crossJoin(F.broadcast(data_end)).select(
        "customer_id", "dob", birth_year.alias("birth_year"),
        C.generation(birth_year).alias("generation"),
        (F.year("data_end") - birth_year).alias("age_at_end"),
        "gender", "city_pop",
        C.city_size_band("city_pop").alias("city_size_band"),
        (F.col("n_values") == 3).alias("attributes_consistent"),
    )
