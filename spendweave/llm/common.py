"""Helpers shared by the corpus operators: stage tables in the shared folder, word rules, running totals."""
from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# White space of the contracts.
SPACE = r"[\x20\x09-\x0D]"
SPACES = SPACE + "+"

_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset (tests), a folder in the session's warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stages"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once in the shared folder and read it back.

    Cuts the lineage: what was drawn or numbered stays as it is when executors are lost, and is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def track(spark: SparkSession, path: str) -> None:
    """Let ``release`` delete this folder too."""
    known = _written.setdefault(spark.sparkContext.applicationId, [])
    if path not in known:
        known.append(path)


def stages_written(spark: SparkSession) -> int:
    """How many stages exist now; give it to ``release`` later to delete only newer ones."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete this session's stage files from number ``since`` on. Frames that still read them can't be used then."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    _delete(spark, paths[since:])
    del paths[since:]


def release_all_but(spark: SparkSession, since: int) -> None:
    """As ``release``, but for the stage written last."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    _delete(spark, paths[since:-1])
    del paths[since:-1]


def paths_since(spark: SparkSession, since: int) -> list[str]:
    return _written.get(spark.sparkContext.applicationId, [])[since:]


def release_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete these stages."""
    _delete(spark, paths)
    written = _written.get(spark.sparkContext.applicationId, [])
    written[:] = [p for p in written if p not in paths]


def words(text: Column) -> Column:
    """Array of the maximal runs outside the fixed white space; empty for null or blank text."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACES}|{SPACES}$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))


def n_words(text: Column) -> Column:
    """Number of words without building them twice."""
    return F.size(words(text)).cast("long")


def slices_for(rows: int) -> int:
    """Slices for a two-level numbering: both the slices of a key and the rows of a slice grow as the square root."""
    return max(1, math.isqrt(max(0, rows)))


def running_total(df: DataFrame, keys: list[str], piece: str, order: list[Column], value: Column, out: str,
                  merge: bool = False) -> DataFrame:
    """Exclusive running sum of ``value`` within ``keys``, in the order (piece, *order).

    ``keys`` and ``piece`` must not be null. A key may hold any share of all rows: totals per (key, piece) are summed
    first, the rows are then summed within their piece only, so no task has to hold a key. With ``merge`` the totals, one row for each
    piece, are never broadcast; the rows are dealt by (key, piece) for the inner sums anyway.
    """
    before, within = "_before", "_value"
    rows = df.withColumn(within, value)
    totals = rows.groupBy(*keys, piece).agg(F.sum(within).alias(before))
    earlier = W.partitionBy(*keys).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    inner = W.partitionBy(*keys, piece).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (rows.join(offsets.hint("merge") if merge else offsets, [*keys, piece])
            .withColumn(out, F.col(before) + F.coalesce(F.sum(within).over(inner), F.lit(0)))
            .drop(before, within))
