"""Silhouette on plain distances: exact, or between bounds without pairs of customers.

Exact: different points are dealt to blocks by their hash, and every two blocks meet in a task of their own that works out each distance once,
for both of its ends. Tasks hold two blocks, a block collects a sum for each of its points and labels. The work is that of all pairs of
different points.

Between bounds: a tree of balls over all customers is grown in passes; of every leaf and label the number of customers, their mean and their variances
are kept (cells). For a customer at distance D from a cell's mean with total variance T, the mean distance to the cell's customers lies
between D and sqrt(D^2 + T) (Jensen's inequality both times), and close to sqrt(D^2 + T - V), V being the variance along the line
to the mean. So every customer meets cells, not customers, and the result comes with bounds that hold. The driver holds the tree and the cells: at most ``leaves`` times the number of labels, whatever the number of customers.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_BLOCKS = 16        # blocks that different points are dealt to, so that there are tasks enough
PAIR_ROWS = (2048, 65_536)      # about the fewest points of a block, where there are fewer blocks, and the most, where there are more
TILE = (256, 256)       # points of two blocks whose distances are held at once, few enough for a core's cache
PASSES = 64             # the most passes that grow the tree
NOISE = 1e-12           # a variance below this is rounding
BLOCK = (64, 2048)      # customers and cells whose distances are held at once, few enough for a core's cache
TASK_DISTANCES = 1 << 30        # distances that a task works out

RESULT = "labelling int, label int, customers long, silhouette double, at_least double, at_most double"


class BallTree:
    """Halved at the mean of the widest column, the leaves with the largest spread (customers times variance) first."""

    def __init__(self, columns: int):
        self.left, self.column, self.cut = [-1], [0], [0.0]      # left child (the right one follows it), -1 for a leaf
        self.origin = [np.zeros(columns)]                        # a point nearby, about which moments are taken

    def split(self, node: int, mean: np.ndarray, column: int) -> None:
        self.left[node], self.column[node], self.cut[node] = len(self.left), column, float(mean[column])
        for _ in range(2):
            self.left.append(-1)
            self.column.append(0)
            self.cut.append(0.0)
            self.origin.append(mean)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        left, column, cut = np.array(self.left), np.array(self.column), np.array(self.cut)
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(left[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = left[at] + (x[inner, column[at]] > cut[at])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("x", "labels"))


def _summed(points: DataFrame, tasks_sums, width: int) -> list:
    """Rows (group, cell, sums) of all tasks, added by Spark."""
    def work(batches):
        for group, cells, sums in tasks_sums(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), group, np.int32)), pa.array(cells.astype(np.int64)),
                                              pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["t", "c", "s"])

    parts = points.select("x", "labels").mapInArrow(work, "t int, c long, s array<double>")
    return parts.groupBy("t", "c").agg(F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(width)]).alias("s")).collect()


def _moments(x: np.ndarray, key: np.ndarray, total: np.ndarray) -> None:
    """Add count, sums and sums of squares of the rows of each key to the key's row of ``total``."""
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    sorted_x = x[order]
    d = x.shape[1]
    total[keys, 0] += np.diff(np.append(first, len(order)))
    total[keys, 1:1 + d] += np.add.reduceat(sorted_x, first)
    total[keys, 1 + d:] += np.add.reduceat(sorted_x ** 2, first)


def _shape(sums: np.ndarray, origin: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    d = len(origin)
    n, shift = sums[0], sums[1:1 + d] / sums[0]
    variance = sums[1 + d:] / n - shift ** 2
    return n, origin + shift, np.where(variance > NOISE * (1 + shift ** 2), variance, 0.0)


def grow(points: DataFrame, columns: int, leaves: int) -> BallTree:
    """The tree over all customers. A pass splits every leaf of the last one that has spread, as long as there is room."""
    tree, fresh, waiting, count = BallTree(columns), [0], {}, 1
    for _ in range(PASSES):
        number = {node: i for i, node in enumerate(fresh)}
        lookup = np.full(len(tree.left), -1)
        lookup[fresh] = range(len(fresh))

        def sums(batches):
            total = np.zeros((len(number), 1 + 2 * columns))
            for x, _ in _rows(batches):
                leaf = tree.leaf_of(x)
                new = np.flatnonzero(lookup[leaf] >= 0)
                if len(new):
                    _moments(x[new] - np.array(tree.origin)[leaf[new]], lookup[leaf[new]], total)
            some = np.flatnonzero(total[:, 0])
            yield 0, some, total[some]

        for r in sorted(_summed(points, sums, 1 + 2 * columns)):
            n, mean, variance = _shape(np.array(r["s"]), tree.origin[fresh[r["c"]]])
            if variance.max() > 0:
                waiting[fresh[r["c"]]] = (n * variance.sum(), mean, int(variance.argmax()))
        chosen = sorted(waiting, key=lambda node: (-waiting[node][0], node))[:max(0, leaves - count)]
        if not chosen:
            break
        fresh = []
        for node in chosen:
            _, mean, column = waiting.pop(node)
            fresh += [len(tree.left), len(tree.left) + 1]
            tree.split(node, mean, column)
        count += len(chosen)
    return tree


def _score(own: np.ndarray, other: np.ndarray, label: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Silhouettes from sums of distances to each label's customers, one for the own label and one for the others."""
    at = np.arange(len(label))
    inner = own[at, label] / np.maximum(sizes[label] - 1, 1)
    mean = np.divide(other, sizes, out=np.full_like(other, np.inf), where=sizes > 0)
    mean[at, label] = np.inf
    outer = mean.min(axis=1)
    larger = np.maximum(inner, outer)
    return np.where((sizes[label] <= 1) | (larger <= 0), 0.0, (outer - inner) / np.where(larger > 0, larger, 1))


class Cells:
    """What one labelling's customers look like: a row for every leaf and label that occurs."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, variance: np.ndarray, label: np.ndarray, labels: int):
        self.middle = n @ mean / n.sum()                         # distances are taken from here, so large coordinates cancel
        self.sizes = np.bincount(label, n, labels)
        mean, spread = mean - self.middle, variance.sum(axis=1)
        wide = spread > 0
        order = np.lexsort((wide, label))                        # a label's cells lie together, those of equal points first
        mean, variance, label, wide, self.n, self.spread = mean[order], variance[order], label[order], wide[order], n[order], spread[order]
        one = np.ones((len(n), 1))
        # so that [x, |x|^2, 1] times a column is the squared distance, and [x^2, x, 1] times one the variance along the line times that
        self.squared = np.concatenate([-2 * mean, one, (mean ** 2).sum(axis=1)[:, None]], axis=1).T.copy()
        self.along = np.concatenate([variance, -2 * mean * variance, (mean ** 2 * variance).sum(axis=1)[:, None]], axis=1).T.copy()
        kind = 2 * label + wide
        starts = np.flatnonzero(np.diff(kind, prepend=-1))
        self.blocks = [(int(label[s]), bool(wide[s]), at, min(at + BLOCK[1], e))
                       for s, e in zip(starts, [*starts[1:], len(kind)]) for at in range(s, e, BLOCK[1])]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of distances of each customer to each label's customers: at least, about, at most. They are one where a cell has no spread."""
        x = x - self.middle
        one = np.ones((len(x), 1))
        to_square, to_along = np.concatenate([x, (x ** 2).sum(axis=1)[:, None], one], axis=1), np.concatenate([x ** 2, x, one], axis=1)
        low, about, high = (np.zeros((len(x), len(self.sizes))) for _ in range(3))
        for label, wide, start, end in self.blocks:
            n, spread = self.n[start:end], self.spread[start:end]
            squared = to_square @ self.squared[:, start:end]
            np.maximum(squared, 0, out=squared)
            if not wide:
                found = np.sqrt(squared, out=squared) @ n
                low[:, label] += found
                about[:, label] += found
                high[:, label] += found
                continue
            along = to_along @ self.along[:, start:end]
            along /= np.maximum(squared, NOISE)
            np.clip(along, 0, spread, out=along)
            along[squared <= NOISE] = 0
            most = squared + spread
            np.subtract(most, along, out=along)
            for total, part in ((low, squared), (about, along), (high, most)):
                total[:, label] += np.sqrt(part, out=part) @ n
        return low, about, high

    def scores(self, x: np.ndarray, label: np.ndarray) -> np.ndarray:
        """(customers, 3): about, at least, at most. The only member of a label scores zero."""
        low, about, high = self.distances(x)
        return np.stack([_score(own, other, label, self.sizes) for own, other in ((about, about), (high, low), (low, high))], axis=1)


def _cells(points: DataFrame, tree: BallTree, labels: list[int]) -> list[Cells]:
    leaf_nodes = np.flatnonzero(np.array(tree.left) < 0)
    number = np.full(len(tree.left), -1)
    number[leaf_nodes] = range(len(leaf_nodes))
    origin = np.array(tree.origin)
    columns = origin.shape[1]

    def sums(batches):
        total = [np.zeros((len(leaf_nodes) * k, 1 + 2 * columns)) for k in labels]
        for x, given in _rows(batches):
            leaf = tree.leaf_of(x)
            for t, k in enumerate(labels):
                _moments(x - origin[leaf], number[leaf] * k + given[:, t], total[t])
        for t, part in enumerate(total):
            some = np.flatnonzero(part[:, 0])
            yield t, some, part[some]

    shapes: list[list] = [[] for _ in labels]
    for r in sorted(_summed(points, sums, 1 + 2 * columns)):
        leaf, label = divmod(r["c"], labels[r["t"]])
        shapes[r["t"]].append((*_shape(np.array(r["s"]), origin[leaf_nodes[leaf]]), label))
    return [Cells(*[np.array(v) for v in zip(*rows)], k) for rows, k in zip(shapes, labels)]


def spread_out(points: DataFrame, cells: list[Cells]) -> DataFrame:
    """The points in as many tasks as their distances to the cells ask for: a small table lies in few."""
    tasks = math.ceil(cells[0].sizes.sum() * sum(len(c.n) for c in cells) / TASK_DISTANCES)
    return points.repartition(tasks) if tasks > points.rdd.getNumPartitions() else points


def _dealt(different: DataFrame, blocks: int) -> RDD:
    """Rows (block, x, times, labels): the different points of each block as bytes of numpy arrays."""
    def pack(key, table):
        n = table.num_rows
        x, given = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("x", "labels"))
        times = table.column("times").to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int32()), "x": [x.astype(float).tobytes()],
                         "times": [times.astype(float).tobytes()], "labels": [given.astype(np.int32).tobytes()]})

    numbered = different.withColumn("block", F.pmod(F.xxhash64("x", "labels"), F.lit(blocks)).cast("int"))
    return numbered.groupBy("block").applyInArrow(pack, "block int, n int, x binary, times binary, labels binary").rdd


def _pair_sums(one: np.ndarray, other: np.ndarray, to_one: np.ndarray, to_other: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each point of one block the sum of its distances to the other's points times their weights ``to_other`` (a column for each label),
    and the other way round. A block that meets itself (``same``) is summed one way."""
    middle = one.mean(axis=0)                                    # distances are taken from here, so large coordinates cancel
    one, other = one - middle, other - middle
    left = np.column_stack([one, (one ** 2).sum(axis=1), np.ones(len(one))])
    right = np.column_stack([-2 * other, np.ones(len(other)), (other ** 2).sum(axis=1)])
    sums, back = np.zeros((len(one), to_other.shape[1])), np.zeros((len(other), to_one.shape[1]))
    for i in range(0, len(one), TILE[0]):
        rows = slice(i, i + TILE[0])
        mine = np.ascontiguousarray(to_one[rows].T)
        for j in range(0, len(other), TILE[1]):
            columns = slice(j, j + TILE[1])
            distance = left[rows] @ right[columns].T
            np.maximum(distance, 0, out=distance)
            np.sqrt(distance, out=distance)
            if same:
                at = np.arange(max(i, j), max(i, j, min(i + len(distance), j + distance.shape[1])))
                distance[at - i, at - j] = 0
            else:
                back[columns] += (mine @ distance).T
            sums[rows] += distance @ to_other[columns]
    return sums, back


def _by_pairs(points: DataFrame, labels: list[int]) -> list[list[np.ndarray]]:
    """For each labelling the customers and the sum of their silhouettes, by label, from the distances between all different points."""
    different = points.groupBy("x", "labels").agg(F.count("*").alias("times")).persist(StorageLevel.MEMORY_AND_DISK)
    fewest, most = (math.ceil(different.count() / n) for n in reversed(PAIR_ROWS))
    blocks = max(fewest, min(PAIR_BLOCKS, most))
    sizes = [np.zeros(k) for k in labels]
    for r in different.select("times", F.posexplode("labels")).groupBy("pos", "col").agg(F.sum("times").alias("n")).collect():
        sizes[r["pos"]][r["col"]] = r["n"]
    first = np.cumsum([0, *labels])

    def send(row):
        for partner in range(blocks):
            low, high = sorted((row["block"], partner))
            yield high * (high + 1) // 2 + low, row

    def unpacked(row):
        n = row["n"]
        x, times, given = (np.frombuffer(row[c], t).reshape(n, -1) for c, t in (("x", float), ("times", float), ("labels", np.int32)))
        weight = np.zeros((n, first[-1]))                        # how often a point counts for each label of each labelling
        np.put_along_axis(weight, first[:-1] + given, times, axis=1)
        return x, weight, times, given

    def meet(number, sent):
        high = (math.isqrt(8 * number + 1) - 1) // 2
        low, rows = number - high * (high + 1) // 2, {row["block"]: row for _, row in sent}
        if low == high and low in rows:
            x, weight, times, given = unpacked(rows[low])
            yield low, (_pair_sums(x, x, weight, weight, True)[0], times, given)
        elif low != high and len(rows) == 2:                     # a block that no point fell to sends nothing
            (x, weight, *_), (y, others, *_) = unpacked(rows[low]), unpacked(rows[high])
            sums, back = _pair_sums(x, y, weight, others, False)
            yield from ((low, (sums, None, None)), (high, (back, None, None)))

    def score(parts):
        total, own = 0.0, None
        for _, (sums, *given) in parts:
            total, own = total + sums, own if given[0] is None else given
        if own is not None:
            times, given = own
            found = [np.zeros((2, k)) for k in labels]
            for t, part in enumerate(found):
                scores = _score(*[total[:, first[t]:first[t + 1]]] * 2, given[:, t], sizes[t])
                for row, weight in zip(part, (times[:, 0], times[:, 0] * scores)):
                    row += np.bincount(given[:, t], weight, len(row))
            yield np.concatenate(found, axis=1)

    pairs = _dealt(different, blocks).flatMap(send).partitionBy(blocks * (blocks + 1) // 2).mapPartitionsWithIndex(meet)
    found = np.sum(pairs.partitionBy(blocks).mapPartitions(score).collect(), axis=0)
    different.unpersist()
    return [found[:, first[t]:first[t + 1]] for t in range(len(labels))]


def silhouettes(points: DataFrame, labels: list[int], leaves: int | None = None) -> DataFrame:
    """(labelling, label, customers, silhouette, at_least, at_most): mean silhouette of every label that occurs.

    Exact, whatever the number of customers, from all pairs of different points; with ``leaves`` between bounds, by a tree of at most so many
    leaves.

    ``points`` has ``x`` (array of doubles) and ``labels`` (array of ints, a number below ``labels[i]`` for the i-th labelling), neither
    null; keep it persisted, since a tree reads it some dozen times. Without customers there are no rows. A labelling with one label has
    no silhouette (null). Equal points with different labels are no problem: their distance is zero.
    """
    spark, first = points.sparkSession, points.select("x").first()
    if first is None:
        return spark.createDataFrame([], RESULT)
    if leaves is None:
        rows = []
        for t, (customers, total) in enumerate(_by_pairs(points, labels)):
            several = (customers > 0).sum() > 1
            rows += [(t, int(c), int(customers[c]), *[float(total[c] / customers[c]) if several else None] * 3) for c in np.flatnonzero(customers)]
        return spark.createDataFrame(rows, RESULT)
    tree = grow(points, len(first["x"]), leaves)
    cells = _cells(points, tree, labels)

    def sums(batches):
        total = [np.zeros((k, 4)) for k in labels]
        for x, given in _rows(batches):
            for t, c in enumerate(cells):
                for at in range(0, len(x), BLOCK[0]):
                    mine = given[at:at + BLOCK[0], t]
                    found = np.column_stack([np.ones(len(mine)), c.scores(x[at:at + BLOCK[0]], mine)])
                    np.add.at(total[t], mine, found)
        for t, part in enumerate(total):
            some = np.flatnonzero(part[:, 0])
            yield t, some, part[some]

    rows = [(r["t"], int(r["c"]), int(r["s"][0]), *[v / r["s"][0] if (cells[r["t"]].sizes > 0).sum() > 1 else None for v in r["s"][1:]])
            for r in sorted(_summed(spread_out(points, cells), sums, 4))]
    return spark.createDataFrame(rows, RESULT)


def overall(by_label: DataFrame) -> DataFrame:
    """(labelling, silhouette, silhouette_error): the mean over all customers, and how far it can be from the exact one at most."""
    def mean(name):
        return F.sum(F.col(name) * F.col("customers")) / F.sum("customers")
    return by_label.groupBy("labelling").agg(
        mean("silhouette").alias("silhouette"),
        F.greatest(mean("at_most") - mean("silhouette"), mean("silhouette") - mean("at_least")).alias("silhouette_error"))
