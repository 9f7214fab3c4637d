"""Durable stage tables.

A stage that many results read is written once and read back. That cuts the lineage (plans stay short, a lost executor
costs nothing but the running tasks), keeps column pruning, and gives the planner real sizes to choose joins by. Stages are
managed tables of the session's warehouse, so all executors reach them and dropping a table removes its files.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..functions.session import width

PREFIX = "spendweave_"


def new_name(name: str) -> str:
    return f"{PREFIX}{name}_{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write a stage bucketed by its key and read it back.

    Windows, groupings and joins on the key then start from co-located data and need no exchange. One file per bucket:
    rows are hashed to the buckets before writing. Unless given, the number of buckets follows the session's shuffle partitions;
    stages that are joined need the same one.
    """
    spark, table = df.sparkSession, new_name(name)
    buckets = buckets or width(spark)
    (df.repartition(buckets, key).write.mode("errorifexists").format("parquet")
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return spark.table(table)


def keep_rows(df: DataFrame, name: str) -> DataFrame:
    """Write a stage as its tasks produce it, without an exchange."""
    table = new_name(name)
    df.write.mode("errorifexists").format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def forget(df: DataFrame) -> None:
    """Drop a stage and its files."""
    for name in df.inputFiles()[:1]:
        table = next((p for p in name.split("/") if p.startswith(PREFIX)), None)
        if table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
