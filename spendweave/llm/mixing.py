"""Mix sources to target weights with a low-discrepancy schedule over shuffled equal-token blocks."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, running_total, slices_for, stage

GOLDEN = (math.sqrt(5) - 1) / 2
WEIGHTS = (5, 2, 1)
SHARE = 1.5          # words of the mix, in sizes of the corpus
LIMIT = 2            # no source, and no document, is taken more often than this
BLOCK_WORDS = 4096   # words of a block at most; a slot holds one block
BLOCKS_PER_SOURCE = 256      # blocks that the smallest target should have, where the number of slots allows it
MORE_SLOTS = 16              # times the slots of the largest blocks, and so many blocks for each source more, that there may be


def golden_point(k):
    """Fractional part of k times the golden ratio; k is split, so that doubles keep their precision up to 2^40."""
    high, low = F.shiftright(k, 20), k % (1 << 20)
    step = ((1 << 20) * GOLDEN) % 1
    point = high * F.lit(step) + low * F.lit(GOLDEN)
    return point - F.floor(point)


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """Target words per source (_key, position, source_size, target).

    Sources in code-point order, the null source last, have the weights in turn. A target is weight times a common level, or
    ``limit`` times the size where that is less. Sorted by the level at which they stop, the sources before the first that
    doesn't stop are the stopped ones, so one window gives the level. Windows run over one row per source.
    """
    sizes = rows.groupBy("_key").agg(F.sum("size").alias("source_size"))
    named = W.orderBy(F.col("_key") == "", "_key")
    order = W.orderBy("stops_at", "position")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everywhere = W.partitionBy()
    cap = F.col("source_size") * float(limit)
    ranked = (sizes.withColumn("position", F.row_number().over(named) - 1)
              .withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights))))
              .withColumn("stops_at", cap / F.col("weight"))
              .withColumn("total", F.sum("source_size").over(everywhere) * float(share))
              .withColumn("level", (F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)))
    running = F.when(F.col("level") <= F.col("stops_at"), F.struct("stops_at", "position", "level"))
    level = F.coalesce(F.min(running).over(everywhere)["level"], F.max("stops_at").over(everywhere))
    return ranked.withColumn("target", F.least(F.col("weight") * level, cap)).select("_key", "position", "source_size", "target")


def schedule(sources: DataFrame, n_sources: int, slots: int, points=golden_point) -> DataFrame:
    """Slots (k, _key): the k-th point of the golden-ratio sequence, looked up in the sources' cumulative shares.

    Points and sources meet by equal grid cells. A source too small for any point gets one slot at the end.
    """
    cells = 4 * n_sources
    upto = W.orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    all_of = F.sum("target").over(W.partitionBy())
    shares = (sources.withColumn("hi", F.sum("target").over(upto) / F.greatest(all_of, F.lit(1e-300)))
              .withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("position")), F.lit(0.0)))
              .withColumn("hi", F.when(F.col("position") == n_sources - 1, 1.1).otherwise(F.col("hi")))
              .where("target > 0"))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1)).cast("int")
    spans = shares.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi"))))).select("_key", "lo", "hi", "cell")
    placed = sources.sparkSession.range(slots).withColumnRenamed("id", "k").withColumn("x", points(F.col("k"))).withColumn("cell", cell(F.col("x")))
    hits = placed.join(spans, "cell").where("x >= lo and x < hi").select("k", "_key")
    seen = hits.select("_key").distinct()
    missed = (sources.where("target > 0").join(seen, "_key", "left_anti").select((F.col("position") + slots).cast("long").alias("k"), "_key"))
    return hits.unionByName(missed)


def block_size(words: float, smallest: float, n_sources: int, most: int = BLOCK_WORDS) -> int:
    """Words of a block, the same for all sources: few enough that the smallest target is some hundred blocks, as far as the number of
    slots stays within a multiple of what the largest blocks need."""
    slots = MORE_SLOTS * (words / most + BLOCKS_PER_SOURCE * n_sources)
    return max(1, min(most, math.floor(smallest / BLOCKS_PER_SOURCE)), math.ceil(words / max(slots, 1.0)))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT, block_words: int = BLOCK_WORDS,
        carry: tuple[str, ...] = ("doc_id",), points=golden_point) -> DataFrame:
    """How many words of each document the mix takes, and in which slots of the schedule.

    Each source's documents are put in random order (by a digest of doc_id) and read as one stream of words, over again where
    the target is above its size. Streams are cut into blocks of equal words, one size for all sources; the r-th slot that the schedule
    gives a source holds its block r. So the number of a source's slots decides how much of it is taken: its target, less at most the
    blocks by which a low-discrepancy sequence falls short; the block in which the target ends is cut there. ``points`` maps the slots'
    numbers to the sequence. The hot source is split in slices when its stream is numbered, and its blocks are joined one by one.

    Returns ``carry``, size, source_size, target, taken, taken_passes (words taken in each reading of the stream), slots (the first
    slot of each reading, null where nothing is taken): the mix in the order of slots interleaves the sources.
    Null text: size 0. Null source: a source of its own. Null ids are ordered by their place in the table; repeated rows are
    documents of their own. A corpus without words, or an empty table, has targets 0. Other columns are ignored.
    """
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row"), F.monotonically_increasing_id().cast("string")))
    rows = stage(docs.select(*carry, n_words(F.col("text")).alias("size"),
                             F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_key"),
                             F.md5(F.concat(F.lit("mix|"), named)).alias("_order"),
                             F.monotonically_increasing_id().alias("_row")), "mix-rows")
    sources = stage(source_targets(rows, weights, share, limit), "mix-sources")
    n_sources, words_out, smallest, n_rows = *sources.agg(
        F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.min(F.when(F.col("target") > 0, F.col("target"))), F.lit(0.0))).first(), rows.count()
    each = block_size(words_out, smallest, n_sources, block_words)
    slots = max(math.ceil(words_out / each), 1)
    slices = slices_for(slots)
    planned = stage(schedule(sources, max(1, n_sources), slots, points).withColumn("_slice", F.floor(F.col("k") * slices / slots)), "mix-slots")
    ranked = running_total(planned, ["_key"], "_slice", [F.col("k")], F.lit(1).cast("long"), "rank", merge=True).select("_key", "rank", "k")

    per_source = (sources.join(planned.groupBy("_key").agg(F.count("*").alias("n_slots")), "_key", "left")
                  .withColumn("goal", F.least(F.round("target").cast("long"), F.coalesce("n_slots", F.lit(0)) * each)))
    slice_of = F.shiftright(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * slices_for(n_rows), 32)
    placed = running_total(rows.withColumn("_slice", slice_of), ["_key"], "_slice", [F.col("_order"), F.col("size"), F.col("_row")],
                           F.col("size"), "_start", merge=True)
    streams = placed.join(per_source.select("_key", "source_size", "target", "goal"), "_key")
    streams = stage(streams.select(*carry, "_row", "_key", "size", "source_size", "target", "_start", "goal"), "mix-streams")

    block = lambda p: F.floor(p / each).cast("long")
    turns = range(limit)
    parts = (streams.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))))
             .withColumn("a", F.col("_start") + F.col("turn") * F.col("source_size"))
             .withColumn("b", F.least(F.col("a") + F.col("size"), F.col("goal"))).where("a < b")
             .withColumn("rank", F.explode(F.sequence(block(F.col("a")), block(F.col("b") - 1))))
             .withColumn("words", F.least("b", (F.col("rank") + 1) * each) - F.greatest("a", F.col("rank") * each))
             .select("_row", "_key", "turn", "rank", "words"))
    of = lambda t, c: F.when(F.col("turn") == t, F.col(c))
    used = parts.join(ranked.hint("merge"), ["_key", "rank"]).groupBy("_row").agg(
        F.sum("words").alias("taken"), *[F.sum(of(t, "words")).alias(f"_w{t}") for t in turns], *[F.min(of(t, "k")).alias(f"_k{t}") for t in turns])
    none = F.lit(0).cast("long")
    return (streams.join(used.hint("merge"), "_row", "left")
            .select(*carry, "size", "source_size", "target", F.coalesce("taken", none).alias("taken"),
                    F.array(*[F.coalesce(f"_w{t}", none) for t in turns]).alias("taken_passes"), F.array(*[F.col(f"_k{t}") for t in turns]).alias("slots")))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken",
                            F.array_min("slots").alias("first_slot"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS position FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(position % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
c AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, position
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT arg_min(level, cap / weight) AS level FROM c WHERE level <= cap / weight),
t AS (SELECT source, position, source_size, least(weight * coalesce((SELECT level FROM l), 0), cap) AS target FROM c),
u AS (SELECT source, position, target, row_number() OVER (ORDER BY position) = count(*) OVER () AS last, coalesce(sum(target) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) /
        greatest(sum(target) OVER (), 1e-300), 0) AS lo, sum(target) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) / greatest(sum(target) OVER (), 1e-300) AS hi
      FROM t),
z AS (SELECT greatest(1, least(4096, floor(coalesce(min(target) FILTER (target > 0), 0) / 256)), ceil(sum(target) / greatest(16 * (sum(target) / 4096 + 256 * count(*)), 1)))::BIGINT AS each,
        sum(target) AS words FROM t),
k AS (SELECT k, (k >> 20) * ((1048576 * ((sqrt(5.0::DOUBLE) - 1) / 2)) % 1) + (k % 1048576) * ((sqrt(5.0::DOUBLE) - 1) / 2) AS y
      FROM (SELECT unnest(range(greatest(1, ceil(words / each))::BIGINT)) AS k FROM z)),
h AS (SELECT u.position, count(*) AS n, list(k ORDER BY k) AS ks FROM k JOIN u ON target > 0 AND y - floor(y) >= lo AND (y - floor(y) < hi OR last) GROUP BY ALL),
g AS (SELECT u.source, least(round(target)::BIGINT, coalesce(n, 1) * (SELECT each FROM z)) AS goal,
        coalesce(ks, [position + greatest(1, ceil((SELECT words / each FROM z)))::BIGINT]) AS ks FROM u LEFT JOIN h USING (position)),
p AS (SELECT d.*, t.source_size, t.target, g.goal, g.ks, coalesce(sum(size) OVER (PARTITION BY d.source
        ORDER BY md5('mix|' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
       (greatest(0, least(a + size, goal) - a) + greatest(0, least(a + source_size + size, goal) - a - source_size))::BIGINT AS taken,
       CASE WHEN size > 0 THEN least(CASE WHEN a < goal THEN ks[a // (SELECT each FROM z) + 1] END,
                                     CASE WHEN a + source_size < goal THEN ks[(a + source_size) // (SELECT each FROM z) + 1] END) END AS first_slot
FROM p
"""
