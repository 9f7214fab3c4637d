"""Holdout assignment: customers are randomised once, the first time they fire, and stay in their arm.

The arms are kept in a ledger, a table bucketed by customer. A batch of fires meets it by an anti-join, so only new customers are
assigned; in every segment they continue the count of those assigned before. The share held out is exact in each segment at any time,
and batches that follow each other by month give the same arms however they are cut.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import columns as C
from ..functions.session import width

SEED = 42
NO_SEGMENT = ""           # stratum of customers without a segment
LEDGER = "customer_id BIGINT, segment_name STRING, first_month DATE, first_trigger STRING, place BIGINT, held_out BOOLEAN"


def is_held_out(place: Column, share: float = config.HOLDOUT_SHARE) -> Column:
    """Whether the customer at a place (from 0) of the random order is held out: of the first n, floor(n x share) are."""
    thousandths = F.lit(round(share * 1000)).cast("long")
    return F.floor((place + 1) * thousandths / 1000) > F.floor(place * thousandths / 1000)


def first_fires(events: DataFrame) -> DataFrame:
    """(customer_id, first_month, first_trigger): the earliest fire of each customer, of equal months the first name.
    Fires without customer or month can't be assigned and are left out."""
    first = F.min(F.struct("month", "trigger_name"))
    return (events.where("customer_id is not null and month is not null").groupBy("customer_id").agg(first.alias("f"))
            .select("customer_id", F.col("f.month").cast("date").alias("first_month"), F.col("f.trigger_name").alias("first_trigger")))


def places(newcomers: DataFrame, taken: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``place``: newcomers of a segment by first month, within a month in the order of a hash, after those already there.

    ``taken`` has a row (segment_name, n) for each known segment. A segment may hold any share of all customers: they are numbered
    within (segment, month, hash range) and lifted by the counts of what comes before, 256 rows for each segment and month.
    """
    hashed = newcomers.withColumn("_h", C.hash32(F.lit(seed), "customer_id")).withColumn("_b", F.shiftright("_h", 24))
    piece = ["segment_name", "first_month", "_b"]
    lower = Window.partitionBy("segment_name").orderBy("first_month", "_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = (hashed.groupBy(*piece).agg(F.count("*").alias("_n"))
              .select(*piece, F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
              .join(taken, "segment_name", "left").withColumn("_before", F.col("_before") + F.coalesce("n", F.lit(0))).drop("n"))
    within = F.row_number().over(Window.partitionBy(*piece).orderBy("_h", "customer_id"))
    return (hashed.withColumn("_place", within).join(counts, piece)
            .withColumn("place", (F.col("_before") + F.col("_place") - 1).cast("long")).drop("_h", "_b", "_before", "_place"))


class Ledger:
    """The assigned customers, one row each: a managed table, bucketed and sorted by customer."""

    def __init__(self, spark: SparkSession, name: str, share: float = config.HOLDOUT_SHARE, seed: int = SEED):
        self.spark, self.name, self.share, self.seed = spark, name, share, seed
        columns = ", ".join(LEDGER.split(", "))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
                  f"CLUSTERED BY (customer_id) SORTED BY (customer_id) INTO {width(spark)} BUCKETS")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def newcomers(self, events: DataFrame, segments: DataFrame) -> DataFrame:
        """First fires of customers who aren't in the ledger, with their segment at this time."""
        fresh = first_fires(events).join(self.table().select("customer_id"), "customer_id", "left_anti")
        named = segments.select("customer_id", "segment_name")
        return fresh.join(named, "customer_id", "left").withColumn("segment_name", F.coalesce("segment_name", F.lit(NO_SEGMENT)))

    def assign(self, events: DataFrame, segments: DataFrame) -> DataFrame:
        """Assign the customers who fire for the first time and return the ledger. Nobody's arm is changed by a later batch, by other
        segments or by running a batch again."""
        taken = self.table().groupBy("segment_name").agg(F.count("*").alias("n"))
        placed = places(self.newcomers(events, segments), taken, self.seed)
        rows = placed.select("customer_id", "segment_name", "first_month", "first_trigger", "place",
                             is_held_out(F.col("place"), self.share).alias("held_out"))
        buckets = width(self.spark)
        # what is read here can't be appended to at the same time: the batch is written apart first, which also cuts its lineage
        staging = f"{self.name}_batch"
        self.spark.sql(f"DROP TABLE IF EXISTS {staging}")
        rows.repartition(buckets, "customer_id").write.format("parquet").saveAsTable(staging)
        (self.spark.table(staging).repartition(buckets, "customer_id").write.mode("append").format("parquet")
         .bucketBy(buckets, "customer_id").sortBy("customer_id").saveAsTable(self.name))
        self.spark.sql(f"DROP TABLE {staging}")
        return self.table()

    def arms(self, events: DataFrame) -> DataFrame:
        """Every fire with its customer's arm: ledger and events are both bucketed by customer."""
        return events.join(self.table().select("customer_id", F.col("segment_name"), "held_out"), "customer_id")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def balance(arms: DataFrame) -> DataFrame:
    """Customers, fires and spend at stake per segment, trigger and arm: both arms should have the same mix."""
    return arms.groupBy("segment_name", "trigger_name", "held_out").agg(
        F.countDistinct("customer_id").alias("customers"), F.count("*").alias("fires"), C.money_sum("spend_at_stake").alias("spend_at_stake"))
