"""What the session says about its size."""
from __future__ import annotations

from pyspark.sql import SparkSession


def width(spark: SparkSession) -> int:
    """Partitions for work whose size the planner cannot see: the session's shuffle partitions.

    A local session has no use for more partitions than cores.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    context = spark.sparkContext
    return min(partitions, context.defaultParallelism) if context.master.startswith("local") else partitions
