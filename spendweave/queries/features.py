"""Transactions, dimension, panel, quarters, features, quality."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality
from ..plans.workbench import bench_for

NOISY = ("spend_volatility", "avg_qoq_spend_change", "avg_yoy_spend_change")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Trim floating columns to the digits that do not depend on the order of a sum."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def clean_transactions(spark, sf):
    return bench_for(spark, sf, "card").transactions


def customer_dim(spark, sf):
    return bench_for(spark, sf, "card").customers


def customer_month(spark, sf):
    return bench_for(spark, sf, "account").customer_month


def customer_quarter(spark, sf):
    return bench_for(spark, sf, "account").customer_quarter


def customer_features(spark, sf):
    return rounded(bench_for(spark, sf, "card").customer_features, *NOISY)


def quality_report(spark, sf):
    bench = bench_for(spark, sf, "card")
    return quality.report(bench.customer_features, bench.transactions, bench.customers)


QUERIES = {f.__name__: f for f in (clean_transactions, customer_dim, customer_month, customer_quarter,
                                   customer_features, quality_report)}
