"""Exact deduplication against a persistent digest index."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, stage


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


class DigestIndex:
    """A managed table (digest, keep_id, batch), bucketed and sorted by digest.

    New data comes in batches. The distinct digests of a batch are anti-joined with the index, bucket against bucket, so the index isn't
    shuffled again; what is new is appended. Every append adds a sorted file to each bucket, and a join sorts within a bucket, since
    Spark doesn't merge sorted files. A digest is never changed once it is in.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _append(self, rows: DataFrame) -> None:
        (rows.repartition(self.buckets, "digest").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))

    def add(self, digests: DataFrame, batch: str) -> DataFrame:
        """Append the unseen ones of a batch's distinct digests (columns digest, keep_id).

        A retried batch, after a job that failed half way, adds nothing twice: what got in is found by the anti-join.
        """
        unseen = digests.withColumn("batch", F.lit(batch)).join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        self._append(stage(unseen, "digest-new"))   # a table can't be read while it is appended to
        return self.table()

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def id_ranges(rows: DataFrame, ranges: int):
    """The number of a row's range of doc_id, ranges of about equal size in the order of the ids; null ids are in the last one."""
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.01))) if ranges > 1 else []
    above = [F.when(F.col("doc_id") > F.lit(c), 1).otherwise(0) for c in cuts]
    return F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(sum(above, F.lit(0))), len(cuts) + 1


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str = "0", carry: tuple[str, ...] = ("doc_id",), ranges: int = 1) -> DataFrame:
    """Decide for every row whether it stays, and add the batch to the index.

    Texts are equal when identical after replacing each run of white space by one space; null counts as empty. Of equal
    texts of a batch, the row with the smallest doc_id stays (null ids last; of repeated ids one row), unless the index has
    the text from an earlier batch: then no row stays. Empty tables add nothing. Other columns are ignored.

    With ``ranges`` above one the batch is loaded in that many ranges of doc_id, lowest first, so that each load is smaller and meets what
    the ranges before it have added. The result is the same for any number of ranges.

    Returns ``carry``, keep_id, group_size (rows of this batch with the text), kept, text_sha256. A text that is held by a
    third of all rows is one row for each map task in the aggregation, and its rows are split between tasks in the join.
    """
    rows = stage(docs.select(*carry, F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"),
                             F.monotonically_increasing_id().alias("_row")), "digest-rows")
    id_last = F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.lit(0))
    load, loads = id_ranges(rows, ranges)
    in_batch = stage(rows.groupBy("digest", load.cast("int").alias("_load")).agg(      # a stage, or the anti-join would be planned before the aggregation
        F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id"),
        F.min_by("_row", F.struct(id_last, F.col("doc_id"), F.col("_row"))).alias("_first")), "digest-batch")
    for i in range(loads):
        index.add(in_batch.where(F.col("_load") == i).select("digest", "keep_id"), batch)
    whole = in_batch.drop("keep_id", "_load") if loads == 1 else in_batch.groupBy("digest").agg(
        F.sum("group_size").alias("group_size"), F.min_by("_first", "_load").alias("_first"))
    groups = stage(whole.join(index.table().hint("merge"), "digest").select(
        "digest", "keep_id", "group_size", F.when(F.col("batch") == batch, F.col("_first")).alias("_stays")), "digest-groups")
    joined = rows.join(groups.hint("merge"), "digest")
    return joined.select(*carry, "keep_id", "group_size", F.coalesce(F.col("_row") == F.col("_stays"), F.lit(False)).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The documents in two loads: the second meets the digests of the first in the index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}")
    result = deduplicate(docs, index, ranges=2)
    index.drop()      # the result reads stages, and this index has no later batch
    return result


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
