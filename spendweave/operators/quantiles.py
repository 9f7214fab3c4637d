"""Exact quantiles that never hold a whole group in one task.

``percentile`` keeps every distinct value of a group in one hash map, which is fine for a customer and not for a table.
Here the value range of each wanted rank is narrowed first: rows are counted by equal cells of the range (map-side, a cell is one
row per task), the cell that holds the rank becomes the next range. Rounds go on until every range holds few rows, so the
exact step sorts few rows whatever the size of the table.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# cells per round, and rows of a range from which another round is made
CELLS = 4_096
LEAF_ROWS = 1_000_000
# a customer with more rows than this has its median taken by ranges
HOT_KEY_ROWS = 1_000_000


def quantile_name(q: float) -> str:
    return f"q{round(q * 10_000):05d}"


def _ranks(n: int, probs: list[float]) -> list[int]:
    return sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})


def _in_ranges(rows: DataFrame, ranges: list[tuple], keys: list[str]) -> DataFrame:
    """Rows joined with the ranges of their key: a range is a few numbers for each key and probability."""
    spark, kinds = rows.sparkSession, {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "lo double", "hi double"])
    sent = F.broadcast(spark.createDataFrame(sorted(set(ranges), key=str), schema))
    match = F.col("v").between(F.col("lo"), F.col("hi"))
    for k in keys:
        sent = sent.withColumnRenamed(k, f"_{k}")
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(sent, match).drop(*[f"_{k}" for k in keys])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """Interpolated quantiles of ``value`` per key group, one column ``q<probability * 10000>`` per probability.

    NULL values are ignored. The number of groups has to be small: the driver holds two ranges for each group and probability.
    """
    probs = sorted(probabilities)
    everything = not keys
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    if everything:
        keys, rows = ["_all"], rows.withColumn("_all", F.lit(0))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    # one target for each key and rank: [key, rank in all, rows below its range, rows in the range, lo, hi]
    targets = [[tuple(r[k] for k in keys), rank, 0, r["n"], r["lo"], r["hi"]] for r in sizes for rank in _ranks(r["n"], probs)]
    while any(t[3] > LEAF_ROWS and t[4] < t[5] for t in targets):
        targets = _narrowed(rows, targets, keys)
    return _read_off(df, rows, targets, sizes, keys, probs, everything)


def _narrowed(rows, targets, keys):
    wide = [t for t in targets if t[3] > LEAF_ROWS and t[4] < t[5]]
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    cells = (_in_ranges(rows, [(*t[0], t[4], t[5]) for t in wide], keys)
             .groupBy(*keys, "lo", "hi", F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).alias("cell"))
             .agg(F.count("*").alias("c"), F.min("v").alias("first"), F.max("v").alias("last")))
    upto = F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("cell"))       # CELLS rows at most
    wanted = F.array(*[F.struct(F.lit(t[4]).alias("lo"), F.lit(t[5]).alias("hi"), F.lit(t[1] - t[2]).alias("rank")) for t in wide])
    hits = (cells.withColumn("below", upto - F.col("c"))
            .filter(F.exists(wanted, lambda w: (w["lo"] == F.col("lo")) & (w["hi"] == F.col("hi"))
                             & (w["rank"] >= F.col("below")) & (w["rank"] < F.col("below") + F.col("c")))).collect())
    found = {}
    for h in hits:
        found.setdefault((tuple(h[k] for k in keys), h["lo"], h["hi"]), []).append(h)
    out = []
    for key, rank, below, n, lo, hi in targets:
        for h in found.get((key, lo, hi), ()):
            if h["below"] <= rank - below < h["below"] + h["c"]:
                out.append([key, rank, below + h["below"], h["c"], h["first"], h["last"]])
                break
        else:
            out.append([key, rank, below, n, lo, hi])
    return out


def _read_off(df, rows, targets, sizes, keys, probs, everything) -> DataFrame:
    """Values at the target ranks from the rows of their ranges, then the interpolation."""
    spark = df.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = [quantile_name(p) for p in probs]
    out_keys = [] if everything else keys
    if not sizes:
        kept = [f"`{k}` {kinds[k]}" for k in out_keys]
        empty = [(None,) * len(probs)] if everything else []
        return spark.createDataFrame(empty, ", ".join([*kept, *[f"{c} double" for c in columns]]))
    held = _in_ranges(rows, [(*t[0], t[4], t[5]) for t in targets], keys).groupBy(*keys, "lo", "hi", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("v"))          # LEAF_ROWS rows, or equal values, at most
    held = held.withColumn("upto", upto)
    places = []
    for r in sizes:
        key = tuple(r[k] for k in keys)
        by_rank = {t[1]: t for t in targets if t[0] == key}
        for i, p in enumerate(probs):
            at = p * (r["n"] - 1)
            for rank, weight in {math.floor(at): 1 - (at - math.floor(at)), math.ceil(at): at - math.floor(at)}.items() if at % 1 else [(int(at), 1.0)]:
                _, _, below, _, lo, hi = by_rank[rank]
                places.append((*key, lo, hi, rank - below, i, weight))
    schema = ", ".join([*[f"`_{k}` {kinds[k]}" for k in keys], "_lo double", "_hi double", "rank long", "i int", "weight double"])
    sent = F.broadcast(spark.createDataFrame(places, schema))
    match = (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    sums = [F.sum(F.when(F.col("i") == i, F.col("v") * F.col("weight"))).alias(c) for i, c in enumerate(columns)]
    return held.join(sent, match).groupBy(*keys).agg(*sums).select(*out_keys, *columns)


def keyed_median(df: DataFrame, key: str, value: str, name: str, hot_keys: DataFrame | None = None) -> DataFrame:
    """Median per key for very many keys, in one exchange: each task sends the distinct values of a key with their counts.

    ``hot_keys`` (one column, the keys above :data:`HOT_KEY_ROWS`, so one for a million rows at most) are taken out and go
    by ranges.
    """
    def small(rows):
        return rows.groupBy(key).agg(F.percentile(value, 0.5).alias(name))

    rows = df.select(key, value)
    if hot_keys is None:
        return small(rows)
    cold = small(rows.join(hot_keys, key, "left_anti"))
    hot = exact_quantiles(rows.join(hot_keys, key, "left_semi"), [key], value, [0.5])
    return cold.unionByName(hot.select(key, F.col(quantile_name(0.5)).alias(name)))


def find_hot_keys(panel: DataFrame, key: str = "customer_id", weight: str = "txns",
                  threshold: int = HOT_KEY_ROWS) -> DataFrame | None:
    """Keys above the threshold, or None when there are none. Reads the small panel, not the transactions."""
    hot = panel.groupBy(key).agg(F.sum(weight).alias("n")).filter(F.col("n") > threshold).select(key)
    return None if hot.isEmpty() else hot
