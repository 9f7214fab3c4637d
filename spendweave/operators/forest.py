"""Random forests on binned predictors.

Every predictor has at most 128 bins, so customers with the same bins (a cell) can't be told apart by any tree. A tree needs the counts of
labels by cell only: a bootstrap that draws each customer Poisson(1) times draws a cell's n customers of a label Poisson(n) times together.
Customers are counted in one aggregation, trees grow from the counts in tasks, and a cell's prediction goes back to its customers
by a join. So the work of the trees is bounded by cells and trees; that of the aggregation and the join is linear.

The driver holds the counts: bins of all predictors multiplied, times labels and folds at most, and never more than the customers.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import bucket_of

BINS = 128              # a birth year each
LEAST = 5               # customers of a bag on either side of a cut
TREES_PER_TASK = 20


def bin_splits(values: DataFrame, columns: list[str]) -> list[list[float]]:
    """Lower ends of all bins but the first: a bin for each value where there are few, else about equally filled ones."""
    points = values.agg(*[F.percentile_approx(c, [i / BINS for i in range(1, BINS)], 10_000).alias(c) for c in columns]).first()
    out = []
    for c in columns:
        few = sorted(r[0] for r in values.select(c).distinct().limit(BINS + 1).collect())
        out.append(few[1:] if len(few) <= BINS else sorted(set(points[c])))
    return out


def leaf_shares(codes: np.ndarray, bag: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """A tree by Gini impurity over the cells: for each cell the shares of the labels in its leaf.

    ``codes`` are the cells' bins (cells, predictors), ``bag`` how often each label was drawn (cells, labels). Each node tries a random
    subset of the predictors, as many as the root of their number.
    """
    tries = math.ceil(math.sqrt(codes.shape[1]))
    shares, live, node = np.zeros(bag.shape), np.arange(len(codes)), np.zeros(len(codes), np.int64)
    for level in range(depth + 1):
        drawn, bins = bag[live], codes[live]
        by_node = np.argsort(node, kind="stable")
        first = np.flatnonzero(np.diff(node[by_node], prepend=-1))
        total = np.add.reduceat(drawn[by_node], first, axis=0)
        n = total.sum(axis=1)
        shares[live] = (total / np.maximum(n, 1)[:, None])[node]
        best = (total ** 2).sum(axis=1) / np.maximum(n, 1) * (1 + 1e-12)
        column, cut = np.full(len(n), -1), np.zeros(len(n), np.int64)
        if level == depth:
            break
        tried = rng.random((len(n), codes.shape[1])).argsort(axis=1).argsort(axis=1) < tries
        tried &= (n >= 2 * LEAST)[:, None]
        for c in range(codes.shape[1]):
            rows = np.flatnonzero(tried[node, c])
            if not len(rows):
                continue
            key = node[rows] * BINS + bins[rows, c]
            order = np.argsort(key, kind="stable")
            key, summed = key[order], np.cumsum(drawn[rows[order]], axis=0)
            own = key // BINS
            start = np.flatnonzero(np.diff(own, prepend=-1))
            before = np.zeros((len(n), bag.shape[1]))
            before[own[start[1:]]] = summed[start[1:] - 1]
            at = np.flatnonzero((key[1:] != key[:-1]) & (own[1:] == own[:-1]))
            left = summed[at] - before[own[at]]
            right = total[own[at]] - left
            a, b = left.sum(axis=1), right.sum(axis=1)
            fits = (a >= LEAST) & (b >= LEAST)
            at, left, right, a, b = at[fits], left[fits], right[fits], a[fits], b[fits]
            score, owner = (left ** 2).sum(axis=1) / a + (right ** 2).sum(axis=1) / b, own[at]
            top = best.copy()
            np.maximum.at(top, owner, score)
            wins = np.flatnonzero((score == top[owner]) & (score > best[owner]))
            owners, one = np.unique(owner[wins], return_index=True)
            column[owners], cut[owners], best[owners] = c, key[at[wins[one]]] % BINS, top[owners]
        number = np.cumsum(column >= 0) - 1
        going = np.flatnonzero(column[node] >= 0)
        if not len(going):
            break
        parent = node[going]
        node = 2 * number[parent] + (bins[going, column[parent]] > cut[parent])
        live = live[going]
    return shares


def out_of_fold(inputs: DataFrame, trees: int, depth: int, seed: int) -> DataFrame:
    """(customer_id, fold, y, predicted): everybody by the forest that hasn't seen the customer's fold.

    ``inputs`` has customer_id, v (vector), fold (from 0) and y (from 0), none of them null; it is read a few times, so keep it persisted.
    """
    spark, width = inputs.sparkSession, len(inputs.first()["v"])
    names = [f"_x{i}" for i in range(width)]
    x = vector_to_array("v")
    values = inputs.select("customer_id", "fold", F.col("y").cast("int").alias("y"), *[F.get(x, F.lit(i)).alias(c) for i, c in enumerate(names)])
    splits = bin_splits(values, names)
    cell = sum((bucket_of(F.col(c), s).cast("long") * F.lit(BINS ** i) for i, (c, s) in enumerate(zip(names, splits))), F.lit(0).cast("long"))
    coded = values.select("customer_id", "fold", "y", cell.alias("cell"))

    counted = coded.groupBy("fold", "cell", "y").agg(F.count("*").alias("n")).orderBy("fold", "cell", "y").toArrow()
    fold, y, n = (counted.column(c).to_numpy().astype(np.int64) for c in ("fold", "y", "n"))
    cells, at = np.unique(counted.column("cell").to_numpy(), return_inverse=True)
    codes = cells[:, None] // BINS ** np.arange(width) % BINS
    folds = int(fold.max()) + 1
    counts = np.zeros((folds, len(cells), int(y.max()) + 1), np.int64)
    counts[fold, at, y] = n

    def grown(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number in batch.column("id").to_pylist():
                out = number // trees
                rng = np.random.default_rng([seed, number])
                bag = rng.poisson(counts.sum(axis=0) - counts[out]).astype(float)
                total[out] = total.get(out, 0) + leaf_shares(codes, bag, depth, rng)
        for out, shares in total.items():
            held = np.flatnonzero(counts[out].sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), out, np.int32)), pa.array(cells[held]),
                                              pa.array(shares[held].tolist(), pa.list_(pa.float64()))], names=["fold", "cell", "shares"])

    numbers = spark.range(0, folds * trees, 1, math.ceil(folds * trees / TREES_PER_TASK))
    votes = numbers.mapInArrow(grown, "fold int, cell long, shares array<double>").groupBy("fold", "cell").agg(
        F.array(*[F.round(F.sum(F.get("shares", F.lit(i))), 9) for i in range(counts.shape[2])]).alias("votes"))
    told = votes.select("fold", "cell", (F.array_position("votes", F.array_max("votes")) - 1).alias("predicted"))
    return coded.join(told, ["fold", "cell"]).select("customer_id", "fold", "y", "predicted")
