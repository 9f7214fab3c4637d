"""Connected components of a link table, by stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node reachable.

    ``links``: columns a, b (any orderable type, no nulls needed; self links are left out). Each round hangs the larger
    neighbours of every node under its smallest one, then the smaller neighbours too (Kiveris et al. 2014): rows never
    outnumber the links, minima are pre-aggregated, and a hub's rows, which meet one row, can be split between tasks because
    both sides of each join are read from stages.
    """
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "links-least")
        large = stage(both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct(), "links-large")
        smallest = stage(large.groupBy("hi").agg(F.min("lo").alias("m")), "links-small")
        joined = large.join(smallest, "hi")
        small = (joined.select(F.col("m").alias("lo"), F.col("hi"))
                 .unionByName(joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo <> hi")).distinct())
        edges = stage(small, "links")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark = seen
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
