"""Contract checks on stage outputs."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import columns as C


class QualityError(ValueError):
    """A stage output breaks its contract."""


def feature_violations(features: DataFrame) -> DataFrame:
    """One row of violation counts: key, wallet shares, gaps in the clustering inputs, generation labels."""
    shares = C.add_all([F.col(c) for c in config.SHARE_COLUMNS])
    holes = reduce(or_, [F.col(c).isNull() for c in config.CLUSTER_COLUMNS])
    return features.agg(
        (F.count("*") - F.count_distinct("customer_id")).alias("duplicate_customers"),
        F.count_if(F.abs(shares - 1) >= 1e-9).alias("share_sum_violations"),
        F.count_if(holes).alias("cluster_feature_nulls"),
        F.count_if(~F.col("generation").isin(*config.GENERATIONS)).alias("unknown_generations"))


def unmapped(transactions: DataFrame) -> DataFrame:
    return transactions.agg(
        F.count_if(F.col("category_group") == config.UNMAPPED).alias("unmapped_transactions"))


def inconsistent(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count_if(~F.col("attributes_consistent")).alias("inconsistent_customers"))


def report(features: DataFrame, transactions: DataFrame, customers: DataFrame) -> DataFrame:
    return (feature_violations(features)
            .crossJoin(F.broadcast(unmapped(transactions)))
            .crossJoin(F.broadcast(inconsistent(customers))))


def require_clean(violations: DataFrame, ignore: tuple[str, ...] = ("inconsistent_customers",)) -> None:
    """Raise when any count of a one-row violation report is not zero."""
    counts = violations.first().asDict()
    broken = {k: v for k, v in counts.items() if v and k not in ignore}
    if broken:
        raise QualityError(", ".join(f"{v} {k}" for k, v in broken.items()))


def require_unique_names(profiles: DataFrame, name: str = "segment_name") -> None:
    repeated = profiles.groupBy(name).count().filter("count > 1")
    if not repeated.isEmpty():
        raise QualityError(f"repeated {name}")
