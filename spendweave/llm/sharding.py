"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""
from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import running_total, slices_for, stage


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Marked items among ``draws`` from ``good`` marked and ``bad`` other ones.

    Rejection for a log-concave law (Devroye 1987): a flat top of the mode's height with exponential tails lies over the
    law, so a draw takes a constant number of tries at every size.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low

    def log_pmf(x):
        return -(math.lgamma(x + 1) + math.lgamma(good - x + 1) + math.lgamma(draws - x + 1)
                 + math.lgamma(bad - draws + x + 1))

    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    total = math.lgamma(good + bad + 1) - math.lgamma(draws + 1) - math.lgamma(good + bad - draws + 1)
    at_mode = log_pmf(mode)
    p = math.exp(math.lgamma(good + 1) + math.lgamma(bad + 1) - total + at_mode)
    w = 1 + p / 2
    while True:
        y = rng.random() * w / p if rng.random() <= w / (1 + w) else (w + rng.expovariate(1)) / p
        step = math.floor(y + 0.5)
        x = mode + (step if rng.random() < 0.5 else -step)
        if low <= x <= high and rng.random() * min(1.0, math.exp(w - p * y)) <= math.exp(log_pmf(x) - at_mode):
            return x


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard, as a uniform permutation of all rows would have it.

    Row sums are ``block_rows``, column sums are ``shard_rows``.
    """
    rng, left, matrix = random.Random(seed), list(shard_rows), []
    for rows in block_rows:
        rest, out = sum(left), []
        for s, room in enumerate(left):
            rest -= room
            out.append(hypergeometric(rng, room, rest, rows))
            rows -= out[-1]
        left = [a - b for a, b in zip(left, out)]
        matrix.append(out)
    return matrix


def shard(docs: DataFrame, shards: int = 8, seed: int = 42, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Put every row into one of ``shards`` shards in uniformly random order; shard sizes differ by one row at most.

    The rows, without their text, are numbered once and dealt into blocks. The communication matrix says how many rows of a
    block go to each shard; the block is permuted and cut at these counts, rows are exchanged, and each shard is permuted
    again. The driver holds the matrix only: ``shards`` numbers for each of about sqrt(rows) blocks.

    Returns ``carry`` columns, size, text_crc32, shard, slot (gapless from 0 in each shard).
    Null text: size 1, crc 0. Null or repeated ids, and rows equal in everything, are placed one by one: a row's place depends
    on its number, not its content. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    text = F.col("text")
    rows = stage(docs.select(*carry, (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                             F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
                             F.monotonically_increasing_id().alias("_row")), "shard-rows")
    n = rows.count()
    blocks = slices_for(n)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(blocks)))
    counts = {r["_block"]: r["count"] for r in rows.groupBy("_block").count().collect()}
    block_rows = [counts.get(b, 0) for b in range(blocks)]
    matrix = communication_matrix(block_rows, [n // shards + (s < n % shards) for s in range(shards)], seed)
    ends = [{"_block": b, "_ends": [sum(row[:s + 1]) for s in range(shards)]} for b, row in enumerate(matrix)]
    spark = docs.sparkSession
    dealt = (spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<_block:bigint,_ends:array<bigint>>>"))))

    local = W.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 1), "_row"), "_row")
    sent = (rows.withColumn("_rank", F.row_number().over(local))
            .join(F.broadcast(dealt), "_block")
            .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).cast("int"))
            .select(*carry, "size", "text_crc32", "shard", "_row",
                    F.pmod(F.xxhash64(F.lit(seed + 2), "_row"), F.lit(blocks)).alias("_slice")))
    sent = stage(sent, "shard-sent")
    placed = running_total(sent, ["shard"], "_slice", [F.xxhash64(F.lit(seed + 3), "_row"), F.col("_row")], F.lit(1).cast("long"), "slot")
    return placed.select(*carry, "size", "text_crc32", "shard", "slot")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                              F.lit(None).cast("int").alias("grown_shard"))
