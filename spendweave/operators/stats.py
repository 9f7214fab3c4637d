"""Rank tests, contingency tests, multiple-testing correction and resampling as aggregations."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import columns as C

# rows of a value range; the number of ranges follows the table
ROWS_PER_BUCKET = 5_000_000
# the same for ranks, where the equal values of a range meet in one Python worker, and rows that are counted together before
RANK_ROWS = 1_000_000
PACK_ROWS = 1 << 19


# --- ranks without a global sort -------------------------------------------

def range_splits(df: DataFrame, columns, rows_per_bucket: int = ROWS_PER_BUCKET) -> dict[str, list[float]]:
    """Approximate split points per column, one for each ``rows_per_bucket`` rows.

    They only balance the work: ranks come out the same for any splits. Empty lists while the table is small.
    """
    n = df.count()
    buckets = math.ceil(n / rows_per_bucket)
    if buckets <= 1:
        return {c: [] for c in columns}
    probs = [i / buckets for i in range(1, buckets)]
    return {c: sorted(set(found)) for c, found in _quantile_points(df, columns, probs).items()}


def _quantile_points(df: DataFrame, columns, probs: list[float]) -> dict[str, list[float]]:
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 10 * (len(probs) + 1)).alias(c) for c in columns]).first()
    return {c: list(row[c] or []) for c in columns}


def bucket_of(value: Column, splits: list[float], wide: int = 32) -> Column:
    """Number of splits at or below the value, by binary search over blocks of splits."""
    def search(lo, hi):
        if hi - lo <= wide:
            part = F.array(*[F.lit(float(s)) for s in splits[lo:hi]]).cast("array<double>")
            return F.lit(lo) + F.size(F.filter(part, lambda s: s <= value)) if hi > lo else F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < splits[mid], search(lo, mid)).otherwise(search(mid + 1, hi))
    return search(0, len(splits))


def stack_metrics(df: DataFrame, metrics, keys, splits: dict[str, list[float]] | None = None) -> DataFrame:
    """(keys, metric, bucket, value): one row per input row and metric."""
    splits = splits or {m: [] for m in metrics}
    parts = F.array(*[F.struct(
        F.lit(m).alias("metric"), bucket_of(F.col(m).cast("double"), splits[m]).alias("bucket"),
        F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.inline(parts))


def packed_counts(values: DataFrame, keys: list[str], group: str, metrics=None, splits: dict[str, list[float]] | None = None) -> DataFrame:
    """(keys, bucket, group, value, c): the distinct values of some rows at a time with their counts, as arrays.

    One row for each group of a range and :data:`PACK_ROWS` values, so a shuffle carries arrays of numbers and not a row per value.
    ``values`` is stacked, or has a column for each of ``metrics``, whose names come after the keys as ``metric``.
    """
    if metrics is None:
        fields = values.select(*keys, "bucket", group).schema.fields
        rows, limit = values.select(*keys, "bucket", group, "value"), PACK_ROWS
    else:
        metrics, splits = list(metrics), splits or {m: [] for m in metrics}
        own = values.select(*keys, group).schema.fields
        fields = [*own[:-1], T.StructField("metric", T.StringType()), T.StructField("bucket", T.IntegerType()), own[-1]]
        rows = values.select(*keys, group, *[F.col(m).cast("double").alias(m) for m in metrics])
        limit = math.ceil(PACK_ROWS / len(metrics))
    columns = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("value", T.ArrayType(T.DoubleType())), T.StructField("c", T.ArrayType(T.LongType()))])

    def stacked(table: pa.Table) -> Iterator[pa.Table]:
        if metrics is None:
            yield table
            return
        for m in metrics:
            value = table.column(m)
            bucket = np.searchsorted(np.array(splits[m], float), pc.fill_null(value, -math.inf).to_numpy(), side="right")
            name = pa.array([m]).take(pa.array(np.zeros(table.num_rows, np.int64)))
            yield pa.table([*[table.column(k) for k in keys], name, pa.array(bucket.astype(np.int32)), table.column(group), value], [*columns, "value"])

    def counted(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stacked(pa.Table.from_batches(batches)):
            found = table.group_by([*columns, "value"], use_threads=False).aggregate([([], "count_all")])
            lists = found.group_by(columns, use_threads=False).aggregate([("value", "list"), ("count_all", "list")])
            yield from lists.rename_columns([*columns, "value", "c"]).combine_chunks().to_batches()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= limit:
                yield from counted(held)
                held, n = [], 0
        if n:
            yield from counted(held)

    return rows.mapInArrow(pack, schema)


def rank_sums(packed: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(keys, bucket, group, n, r, ties): rows, sum of the ranks inside the range and t^2 - 1 of the rows' ties, by numpy per range.

    NULL is the lowest value, NaN the highest, as in a sort.
    """
    columns = [*keys, "bucket", group]
    fields = packed.select(*columns).schema.fields
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("r", T.DoubleType()), T.StructField("ties", T.DoubleType())])

    def sums(table: pa.Table) -> pa.Table:
        codes = table.column(group).combine_chunks().dictionary_encode("encode")
        lists, c = table.column("value").combine_chunks(), table.column("c").combine_chunks().flatten().to_numpy()
        of = np.repeat(codes.indices.to_numpy(), lists.value_lengths().to_numpy())
        distinct, at = np.unique(pc.fill_null(lists.flatten(), -math.inf).to_numpy(), return_inverse=True)
        t = np.bincount(at, c, len(distinct))
        rank = np.cumsum(t) - (t - 1) / 2
        n, r, ties = (np.bincount(of, c * x, len(codes.dictionary)) for x in (np.ones(len(c)), rank[at], (t * t - 1)[at]))
        same = table.select([*keys, "bucket"]).slice(0, 1).take(pa.array(np.zeros(len(n), np.int64)))
        return same.append_column(group, codes.dictionary).append_column("n", pa.array(n.astype(np.int64))).append_column(
            "r", pa.array(r)).append_column("ties", pa.array(ties))

    return packed.groupBy(*keys, "bucket").applyInArrow(sums, schema)


def kruskal(values: DataFrame, keys: list[str], group: str, metrics=None, splits: dict[str, list[float]] | None = None) -> DataFrame:
    """Kruskal-Wallis per key: statistic with tie correction, p, epsilon squared.

    ``values`` has the keys, ``bucket``, ``value`` and the group column, or a column for each of ``metrics`` (then a key ``metric`` is
    added), which Arrow carries to the tasks' Python in far fewer rows. Equal values are counted first, ranks are
    built inside each value range and lifted by the number of rows in the lower ranges, so no sort spans all rows.
    """
    packed = packed_counts(values, keys, group, metrics, splits)
    keys = keys if metrics is None else [*keys, "metric"]
    by_bucket = rank_sums(packed, keys, group)
    lower = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    by_group = (by_bucket.withColumn("lower", F.coalesce(F.sum("n").over(lower), F.lit(0)))
                .groupBy(*keys, group).agg(
                    F.sum("n").alias("n"), F.sum(F.col("r") + F.col("lower") * F.col("n")).alias("r"),
                    F.sum("ties").alias("ties")))
    total = by_group.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum("ties").alias("ties"),
        F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    n = F.col("n").cast("double")
    tie_factor = 1 - C.ratio(F.col("ties"), n * n * n - n)
    h = C.ratio(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), tie_factor)
    statistic = F.when(F.col("groups") >= 2, h)
    return (total.withColumn("statistic", statistic)
            .select(*keys, "statistic", C.chi2_survival("statistic", F.col("groups") - 1).alias("p_value"),
                    C.ratio(F.col("statistic"), F.col("n") - 1).alias("effect_size"), "n"))


def chi_square(pairs: DataFrame, keys: list[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """Chi-square test and bias-corrected Cramer's V per key, from counts of the pairs that occur.

    ``weight`` is the count column of rows that are counted already.

    Cells that never occur contribute only through the margins, since sum((O-E)^2/E) = sum(O^2/E) - N.
    """
    cells = pairs.groupBy(*keys, a, b).agg((F.sum(weight) if weight else F.count("*")).alias("c"))
    row, column = Window.partitionBy(*keys, a), Window.partitionBy(*keys, b)
    margins = (cells.withColumn("row_n", F.sum("c").over(row).cast("double"))
               .withColumn("col_n", F.sum("c").over(column).cast("double")))
    total = margins.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c") / (F.col("row_n") * F.col("col_n"))).alias("s"),
        F.count_distinct(a).cast("double").alias("r"), F.count_distinct(b).cast("double").alias("k"))
    n, r, k = F.col("n").cast("double"), F.col("r"), F.col("k")
    dof = (r - 1) * (k - 1)
    chi2 = F.greatest(F.lit(0.0), n * F.col("s") - n)
    statistic = F.when(dof > 0, chi2).otherwise(F.lit(0.0))
    phi2 = F.greatest(F.lit(0.0), statistic / n - C.ratio(dof, n - 1))
    r_adj, k_adj = r - C.ratio((r - 1) * (r - 1), n - 1), k - C.ratio((k - 1) * (k - 1), n - 1)
    room = F.least(r_adj - 1, k_adj - 1)
    p = F.when(dof > 0, C.chi2_survival(statistic, dof)).otherwise(F.lit(1.0))
    return total.select(*keys, statistic.alias("statistic"), p.alias("p_value"),
                        F.when(room > 0, F.sqrt(phi2 / F.nullif(room, F.lit(0.0)))).alias("effect_size"), "n")


def holm(tests: DataFrame, p: str = "p_value", out: str = "p_holm") -> DataFrame:
    """Holm step-down over all rows of a result table (one row per test)."""
    by_p = Window.orderBy(F.asc_nulls_last(p))
    everything = Window.partitionBy()
    step = (F.count("*").over(everything) - F.row_number().over(by_p) + 1) * F.col(p)
    return (tests.withColumn("_step", step)
            .withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("_step").over(
                by_p.rowsBetween(Window.unboundedPreceding, 0)))))
            .drop("_step"))


def adjusted_rand(pairs: DataFrame, a: str, b: str, keys: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency counts. ``weight``: count column of counted pairs."""
    def pairs_of(x):
        return F.col(x).cast("double") * (F.col(x).cast("double") - 1) / 2
    cells = pairs.groupBy(*keys, a, b).agg((F.sum(weight) if weight else F.count("*")).alias("c"))
    marked = (cells.withColumn("ra", F.sum("c").over(Window.partitionBy(*keys, a)))
              .withColumn("rb", F.sum("c").over(Window.partitionBy(*keys, b)))
              .withColumn("first_a", F.row_number().over(Window.partitionBy(*keys, a).orderBy(b)) == 1)
              .withColumn("first_b", F.row_number().over(Window.partitionBy(*keys, b).orderBy(a)) == 1))
    sums = marked.groupBy(*keys).agg(
        F.sum(pairs_of("c")).alias("cells"), F.sum(F.when(F.col("first_a"), pairs_of("ra"))).alias("sa"),
        F.sum(F.when(F.col("first_b"), pairs_of("rb"))).alias("sb"), F.sum("c").alias("n"))
    expected = C.ratio(F.col("sa") * F.col("sb"), pairs_of("n"))
    best = (F.col("sa") + F.col("sb")) / 2
    index = C.ratio(F.col("cells") - expected, best - expected)
    return sums.select(*keys, F.coalesce(index, F.lit(1.0)).alias("ari"), "n")


# --- resampling ------------------------------------------------------------

def numbering_pieces(df: DataFrame, order: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add (_b, _part): pieces in the order of a numeric column, of about ``rows_per_bucket`` rows however often a value repeats.

    Split points that come out equal show a value that fills several pieces. Its rows are ties, so they may be dealt out by a hash.
    """
    n = df.count()
    buckets = math.ceil(n / rows_per_bucket)
    points = _quantile_points(df, [order], [i / buckets for i in range(1, buckets)])[order] if buckets > 1 else []
    splits, value = sorted(set(points)), F.col(order).cast("double")
    repeated = [v for v in splits if points.count(v) > 1]
    ranged = df.withColumn("_b", bucket_of(value, splits))
    if not repeated:
        return ranged.withColumn("_part", F.lit(0))
    parts = F.element_at(F.create_map(*[F.lit(x) for v in repeated for x in (v, points.count(v) + 1)]), value)
    row = F.xxhash64(*df.columns)
    return ranged.withColumn("_part", F.when(value.isin(repeated), F.pmod(row, parts)).otherwise(F.lit(buckets + 1)).cast("int"))


def numbered(df: DataFrame, keys: list[str], order: str, out: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the place (from 0) within the keys in the order of a numeric column, ties in any order.

    Rows are numbered inside pieces of the value range and lifted by the rows of the lower pieces.
    """
    pieces = numbering_pieces(df, order, rows_per_bucket)
    lower = Window.partitionBy(*keys).orderBy("_b", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy(*keys, "_b", "_part").agg(F.count("*").alias("_n")).select(
        *keys, "_b", "_part", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_b", "_part").orderBy(order))
    return (pieces.join(offsets, [*keys, "_b", "_part"]).withColumn(out, F.col("_before") + place - 1).drop("_b", "_part", "_before"))


# customers of a group that one task draws from; a replicate's draws are divided between such ranges before any is made
RANGE_ROWS = 1 << 16
REPLICATES_AT_A_TIME = 64

# places on either side of the middle that are counted one by one, in square roots of the sample: the median of a resample
# lies outside with a probability below 1e-50, and the step stops with an error if one does
MIDDLE = 8.0


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 32-bit numbers whose results look random (finaliser of MurmurHash3): draws of a counter."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def range_draws(seed: int, rep: int, part: int, draws: int, rows: int) -> np.ndarray:
    """How often each of the ``rows`` customers of a range is drawn: one number for each draw from (seed, replicate, range, draw)."""
    key = mixed(np.array([(seed * 0x9E3779B1 + rep) % 2 ** 32], np.uint32))
    key = mixed(key + np.array([(part + 1) * 0x85EBCA77 % 2 ** 32], np.uint32))
    u = mixed(key + np.arange(draws, dtype=np.uint32) * np.uint32(0x9E3779B9))
    return np.bincount(((u.astype(np.uint64) * np.uint64(rows)) >> np.uint64(32)).astype(np.int64), minlength=rows)


def divided_draws(seed: int, rep: int, n: int, range_rows: int) -> np.ndarray:
    """The draws of a replicate of ``n`` customers, divided between their ranges: a multinomial, as binomials one after the other."""
    sizes = np.diff([*range(0, n, range_rows), n])
    rng, left, below, out = np.random.default_rng([seed, rep, n]), n, n, []
    for size in sizes.tolist():
        out.append(int(rng.binomial(left, size / below)) if size < below else left)
        left, below = left - out[-1], below - size
    return np.array(out, np.int64)


def _window(n: int) -> tuple[int, int]:
    reach = math.ceil(MIDDLE * math.sqrt(n))
    return max(0, n // 2 - reach), min(n, n // 2 + reach + 1)


def _ends(n: int, start: int, below: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Places of the lower and the upper middle from the draws below the window and at each of its places (a row for each replicate)."""
    upto = below[:, None] + np.cumsum(counts, axis=1)
    ends = []
    for rank in ((n - 1) // 2, n // 2):
        at = (upto <= rank).sum(axis=1)
        if (below > rank).any() or (at == counts.shape[1]).any():
            raise ArithmeticError(f"the median of a resample of {n} lies outside the counted places")
        ends.append(start + at)
    return ends


MIDDLES = "m int, rep int, median double, pos binary, below binary, c binary"


def _range_middles(part: int, n: int, places: np.ndarray, values: np.ndarray, n_boot: int, seed: int, range_rows: int) -> Iterator[list[tuple]]:
    """Rows (m, rep, median, pos, below, c) of some replicates at a time from the customers of one range, with their places and values
    by metric.

    The only range of a group knows the median; one of several tells how often it was drawn below the window around the
    middle, and at each of its places inside it: a row for each metric and block of replicates from ``rep`` on, as numbers packed
    in binary columns.
    """
    rows, n_metrics = places.shape
    (start, stop), alone = _window(n), n <= range_rows
    below_window = (places < start).astype(np.float64)
    inside = [np.flatnonzero((places[:, m] >= start) & (places[:, m] < stop)) for m in range(n_metrics)]
    inside = [at[np.argsort(places[at, m])] for m, at in enumerate(inside)]
    for first in range(0, n_boot, REPLICATES_AT_A_TIME):
        reps = range(first, min(n_boot, first + REPLICATES_AT_A_TIME))
        totals = [n if alone else int(divided_draws(seed, r, n, range_rows)[part]) for r in reps]
        drawn = np.array([range_draws(seed, r, part, t, rows) for r, t in zip(reps, totals)])
        below = np.array([d @ below_window for d in drawn]).astype(np.int64)
        for m in range(n_metrics):
            counts = drawn[:, inside[m]]
            if alone:
                low, high = _ends(n, start, below[:, m], counts)
                ordered = values[inside[m], m]
                yield [(m, r, median, None, None, None)
                       for r, median in zip(reps, ((ordered[low - start] + ordered[high - start]) / 2).tolist())]
            else:
                size = np.uint8 if counts.max(initial=0) < 256 else np.int64
                yield [(m, first, None, places[inside[m], m].astype("<i8").tobytes(), below[:, m].tobytes(), counts.astype(size).tobytes())]


def _arrow_rows(rows: list[tuple], schema) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    fields = [(c.strip().rsplit(" ", 1)) for c in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _matrix_of(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def resampled_medians(people: DataFrame, sizes: DataFrame, group: str, n_boot: int, seed: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(group, m, rep, median) of every replicate and metric.

    ``sizes``: group, n. ``people``: group, n (rows of the group), idx (from 0 in the group), places and values (arrays by metric). No draw is shuffled: a
    replicate's n draws are first divided between ranges of customers, by exact binomials that each range works out for itself, and
    made in the range's task. Groups of several ranges shuffle counts around the middle, about 16 sqrt(n) bytes for each replicate and
    metric. A task holds the counts of one metric and block of replicates at a time.
    """
    schema, ends = f"{group} string, n long, {MIDDLES}", f"{group} string, rep int, m int, low long, high long"

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("idx")          # a range at most
        places, values = (_matrix_of(table.column(c), table.num_rows) for c in ("places", "values"))
        name, n, part = (table.column(c)[0].as_py() for c in (group, "n", "part"))
        for rows in _range_middles(part, n, places, values, n_boot, seed, range_rows):
            yield _arrow_rows([(name, n, *row) for row in rows], schema)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:                                                # a row for each range
            for name, n, m, first, _, pos, below, c in zip(*(batch.column(x) for x in (group, "n", *[f.split()[0] for f in MIDDLES.split(", ")]))):
                name, n, m, first = (v.as_py() for v in (name, n, m, first))
                pos, below = (np.frombuffer(v.as_py(), "<i8") for v in (pos, below))
                if counts is None:
                    start, stop = _window(n)
                    counts, total = np.zeros((len(below), stop - start), np.int64), np.zeros(len(below), np.int64)
                total += below
                if len(pos):
                    size = np.uint8 if len(c.as_py()) == len(pos) * len(below) else np.int64
                    counts[:, pos - start] += np.frombuffer(c.as_py(), size).reshape(len(below), -1)
        low, high = _ends(n, start, total, counts)
        yield _arrow_rows([(name, first + i, m, *at) for i, at in enumerate(zip(low.tolist(), high.tolist()))], ends)

    def by_range(some):
        return some.withColumn("part", F.floor(F.col("idx") / range_rows).cast("int")).groupBy(group, "part").applyInArrow(one, schema)

    columns, (least, most) = (group, "m", "rep", "median"), sizes.agg(F.min("n"), F.max("n")).first()
    if (most or 0) <= range_rows:
        return by_range(people).select(*columns)
    several = people.where(F.col("n") > range_rows)
    middles = by_range(several).groupBy(group, "rep", "m").applyInArrow(together, ends)
    at = F.explode(F.array("low", "high")).alias("pos")
    placed = several.select(group, "n", F.posexplode(F.arrays_zip("places", "values")).alias("m", "v")).select(
        group, "n", "m", F.col("v.places").alias("pos"), F.col("v.values").alias("value"))
    reach = F.abs(F.col("pos") - F.floor(F.col("n") / 2)) <= F.ceil(MIDDLE * F.sqrt("n")) + 1           # the others can't be wanted
    read = (middles.select(group, "rep", "m", at).join(placed.where(reach).drop("n"), [group, "m", "pos"])
            .groupBy(group, "m", "rep").agg(F.avg("value").alias("median")))
    return read if least > range_rows else by_range(people.where(F.col("n") <= range_rows)).select(*columns).unionByName(read)


def median_ci(df: DataFrame, metrics, group: str, order: str, n_boot: int = config.N_RESAMPLES, seed: int = 42,
              range_rows: int = RANGE_ROWS) -> DataFrame:
    """95% bootstrap interval of the median per group and metric. All metrics of a group share the same resampled rows.

    Every metric gives each customer a place in its group; a replicate's median is at the middle of the drawn places. One
    method for every size, and the same result for any partitioning.
    """
    metrics = list(metrics)
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    numbers = numbered(df.select(group, order, *metrics), [group], order, "idx")
    values = numbers.select(group, "idx", F.inline(F.array(*[F.struct(
        F.lit(i).alias("m"), F.col(name).cast("double").alias("value")) for i, name in enumerate(metrics)])))
    by_metric = F.sort_array(F.collect_list(F.struct("m", "pos", "value")))
    people = (numbered(values, [group, "m"], "value", "pos").groupBy(group, "idx").agg(by_metric.alias("p")).join(sizes, group)
              .select(F.col(group).cast("string").alias(group), "n", "idx", F.col("p.pos").alias("places"), F.col("p.value").alias("values")))
    medians = resampled_medians(people, sizes.select(F.col(group).cast("string").alias(group), "n"), group, n_boot, seed, range_rows)
    bounds = medians.groupBy(group, "m").agg(F.percentile("median", [0.025, 0.975]).alias("q"))
    name = F.get(F.array(*[F.lit(m) for m in metrics]), F.col("m"))
    return bounds.select(group, name.alias("metric"), F.get("q", F.lit(0)).alias("median_ci_low"), F.get("q", F.lit(1)).alias("median_ci_high"))
