"""Fitted segments.

Inputs: logged and scaled customer columns as one vector. Fits: many K-means fits at once (every start, every resample, every
number of segments) and many mixtures at once, principal components by Spark ML. Scoring: labels, coordinates, and how well demographics
alone predict a segment. Draws come from hashes of the customer id, so a retried task repeats them.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from hashlib import md5
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import columns as C
from . import forest, segments, silhouette, stats

SEED = 42
FOLDS = 5


# --- matrix ----------------------------------------------------------------

def scaled_columns(features: DataFrame, columns=config.CLUSTER_COLUMNS) -> DataFrame:
    """customer_id and the clustering columns after log1p and scaling by the population deviation.

    Two numbers per column come to the driver; a constant column is centred only.
    """
    logged = {c: F.log1p(F.col(c).cast("double")) for c in columns}
    moments = features.agg(
        *[F.avg(e).alias(f"mean_{c}") for c, e in logged.items()],
        *[F.stddev_pop(e).alias(f"sd_{c}") for c, e in logged.items()]).first()
    return features.select("customer_id", *[
        ((e - moments[f"mean_{c}"]) / (moments[f"sd_{c}"] or 1.0)).alias(c) for c, e in logged.items()])


def prepare_matrix(features: DataFrame, columns=config.CLUSTER_COLUMNS) -> DataFrame:
    """(customer_id, x): the scaled columns as one vector, kept for the iterative fits. ``unpersist`` it afterwards."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol="x")
    matrix = assembler.transform(scaled_columns(features, columns)).select("customer_id", "x")
    return matrix.persist(StorageLevel.MEMORY_AND_DISK)


# --- K-means ---------------------------------------------------------------

@dataclass(frozen=True)
class Fit:
    """One K-means run: ``resample`` is None for all customers as they are, else the number of a bootstrap resample."""
    k: int
    start: int
    resample: int | None = None


@dataclass
class Centres:
    fit: Fit
    centres: np.ndarray
    cost: float = math.inf
    sizes: np.ndarray | None = None
    settled: bool = False
    steps: int = 0
    room: float = 0.0
    far: float = math.inf

    def labels(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centres)[0]

    def transform(self, matrix: DataFrame, label: str = "cluster") -> DataFrame:
        """Add the number of the nearest centre (the first of equal ones)."""
        point = vector_to_array("x")
        distances = F.array(*[F.aggregate(F.zip_with(point, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)),
                                          F.lit(0.0), lambda s, v: s + v) for c in self.centres])
        return matrix.withColumn(label, (F.array_position(distances, F.array_min(distances)) - 1).cast("int"))


def poisson_weights(resamples: int, seed: int = SEED) -> Column:
    """How often a customer is drawn in each resample: Poisson(1) by inversion of a hashed uniform, to the last count that one of
    the 2^32 uniforms reaches. A uniform is hashed once, not once for each bound it meets."""
    if not resamples:
        return F.array().cast("array<int>")
    cumulative, bounds = 0.0, []
    while cumulative < 1 - 2.0 ** -33:
        cumulative += math.exp(-1) / math.factorial(len(bounds))
        bounds.append(F.lit(cumulative))
    uniform = F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)),
                          lambda r: (C.hash32(F.lit(seed), r, "customer_id") + F.lit(0.5)) / F.lit(2.0 ** 32))
    return F.transform(uniform, lambda u: F.size(F.filter(F.array(*bounds), lambda b: b <= u)).cast("int"))


def fit_points(matrix: DataFrame, resamples: int = 0, seed: int = SEED) -> DataFrame:
    """(customer_id, h, x, w): points as arrays with a hash of the customer and its weight in every resample, kept for the fits."""
    return (matrix.select("customer_id", F.xxhash64("customer_id").alias("h"), vector_to_array("x").alias("x"),
                          poisson_weights(resamples, seed).alias("w")).persist(StorageLevel.MEMORY_AND_DISK))


BLOCK = 4_096                   # customers of a packed block
TASK_WORK = 2_000_000           # distances to a centre that are worth a task of their own
TASK_ROWS = 256                 # customers that are worth one


def packed(points: DataFrame, centres: int) -> RDD:
    """The points as blocks (hashes, rows, weights) of numpy arrays, kept for passes that compare each point with this many centres.
    ``unpersist`` them afterwards.

    A pass is a job without a plan. Small tables come in few tasks, large ones keep their partitions.
    """
    def pack(rows):
        while some := list(islice(rows, BLOCK)):
            h, x, w = zip(*some)
            weights = np.array(w, np.int64).reshape(len(some), -1)
            yield np.array(h, np.int64).view(np.uint64), np.array(x, float), weights.astype(np.uint8) if weights.max(initial=0) < 256 else weights

    n = points.count()
    tasks = max(1, min(math.ceil(n * centres / TASK_WORK), math.ceil(n / TASK_ROWS)))
    return points.select("h", "x", "w").coalesce(tasks).rdd.mapPartitions(pack).persist(StorageLevel.MEMORY_AND_DISK)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            n = batch.num_rows
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            yield batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64), x, w


def _by_resample(fits: list[Fit]) -> dict[int | None, list[int]]:
    """Places of the fits that share a resample, so their distances are worked out together."""
    places: dict[int | None, list[int]] = {}
    for i, fit in enumerate(fits):
        places.setdefault(fit.resample, []).append(i)
    return places


def _drawn(w: np.ndarray, resample: int | None) -> tuple[np.ndarray | slice, np.ndarray]:
    """The rows that a resample draws, and how often."""
    if resample is None:
        return slice(None), np.ones(len(w))
    some = np.flatnonzero(w[:, resample])
    return some, w[some, resample].astype(float)


def _squared(columns: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(centres, customers): squared distances but for the customer's own square. ``columns`` has the customers' values, a row each, and ones."""
    return np.column_stack([-2 * centres, (centres ** 2).sum(axis=1)]) @ columns


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distance = np.maximum(0, (x ** 2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(axis=1))
    label = distance.argmin(axis=1)
    return label, distance[np.arange(len(x)), label]


def uniforms(hashed: np.ndarray, tag: str) -> np.ndarray:
    """A number in (0, 1) for each hashed customer, a different one for every tag: the finaliser of SplitMix64 in numpy."""
    x = hashed ^ np.uint64(int.from_bytes(md5(tag.encode()).digest()[:8], "big"))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0 ** 52


ROUNDS, OVERSAMPLE = 3, 2       # rounds of candidates for starting centres, and candidates a round for each centre
TRIES = 8                       # reductions of the candidates to centres, of which the cheapest counts


STRIP = 512             # customers whose distances to the centres of some fits are held at once


def _more_candidates(points: RDD, found: list[Centres], wanted: list[int], number: int, seed: int) -> None:
    """More candidates for every fit, drawn with a chance in proportion to weight times squared distance from those it has: each customer
    draws a hashed waiting time, the shortest win. One pass for all fits."""
    ends, places = np.cumsum(wanted), _by_resample([f.fit for f in found])
    fits, centres, d = [f.fit for f in found], [f.centres for f in found], found[0].centres.shape[1]

    def race(blocks):
        best = np.full((ends[-1], 1 + d), np.inf)                # for each fit its shortest waits, with the customers' values
        for hashed, x, w in blocks:
            squares = (x ** 2).sum(axis=1)
            for resample, group in places.items():
                some, times = _drawn(w, resample)
                mine, h = x[some], hashed[some]
                columns = np.column_stack([mine, np.ones(len(mine))]).T
                for i in group:
                    chance = times
                    if len(centres[i]):
                        least = np.concatenate([_squared(columns[:, at:at + STRIP], centres[i]).min(axis=0) for at in range(0, len(mine), STRIP)]
                                               or [np.zeros(0)])
                        chance = times * np.maximum(0, least + squares[some])
                    drawn = -np.log(uniforms(h, f"{seed}|{fits[i]}|{number}"))
                    waits = np.divide(drawn, chance, out=np.full(len(mine), np.inf), where=chance > 0)
                    rows = best[ends[i] - wanted[i]:ends[i]]
                    sooner = np.flatnonzero(waits < rows[-1, 0])
                    if len(sooner) > wanted[i]:
                        sooner = sooner[np.argpartition(waits[sooner], wanted[i])[:wanted[i]]]
                    if len(sooner):
                        rows[:] = shortest(rows, np.column_stack([waits[sooner], mine[sooner]]))
        yield best

    def shortest(one, other):
        both = np.concatenate([one, other])
        return both[np.argsort(both[:, 0], kind="stable")[:len(one)]]

    def merged(a, b):
        return np.concatenate([shortest(one, other) for one, other in zip(np.split(a, ends[:-1]), np.split(b, ends[:-1]))])

    for f, some in zip(found, np.split(_gathered(points, race, int(ends[-1]), merged), ends[:-1])):
        some = some[some[:, 0] < np.inf]
        if len(some):
            f.centres = np.unique(np.vstack([f.centres, some[:, 1:]]), axis=0)


def _candidate_weights(points: RDD, found: list[Centres]) -> list[np.ndarray]:
    """How much weight is nearest to each candidate."""
    centres, places = [f.centres for f in found], _by_resample([f.fit for f in found])
    ends = np.cumsum([len(c) for c in centres])

    def count(blocks):
        total = [np.zeros(len(c)) for c in centres]
        for _, x, w in blocks:
            for resample, group in places.items():
                some, times = _drawn(w, resample)
                columns = np.column_stack([x[some], np.ones(len(times))]).T
                for i in group:
                    for at in range(0, len(times) if len(centres[i]) else 0, STRIP):
                        away = _squared(columns[:, at:at + STRIP], centres[i])
                        nearest = away == away.min(axis=0)
                        if np.count_nonzero(nearest) != away.shape[1]:       # equally near: the first counts
                            nearest = away.argmin(axis=0) == np.arange(len(away))[:, None]
                        total[i] += nearest @ times[at:at + STRIP]
        yield np.concatenate(total)

    return np.split(_gathered(points, count, len(found)), ends[:-1])


def _reduced(candidates: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of the weighted candidates, by k-means++ and a few steps: some dozen points for each fit."""
    best, least = None, math.inf
    for _ in range(TRIES):
        centres = candidates[[rng.choice(len(candidates), p=weight / weight.sum())]]
        while len(centres) < k:
            chance = weight * _nearest(candidates, centres)[1]
            if not chance.sum() > 0:
                break
            centres = np.vstack([centres, candidates[rng.choice(len(candidates), p=chance / chance.sum())]])
        for _ in range(5):
            member = (_nearest(candidates, centres)[0] == np.arange(len(centres))[:, None]) * weight
            held = member.sum(axis=1, keepdims=True)
            centres = np.where(held > 0, member @ candidates / np.maximum(held, 1e-300), centres)
        cost = float((weight * _nearest(candidates, centres)[1]).sum())
        if cost < least:
            best, least = centres, cost
    return best


def _start(points: RDD, found: list[Centres], seed: int) -> None:
    """Starting centres for all fits at once (k-means||): rounds of oversampled candidates, their weights, then a small reduction.
    The number of passes doesn't depend on the number of centres."""
    _more_candidates(points, found, [1] * len(found), 0, seed)
    for number in range(1, ROUNDS + 1):
        _more_candidates(points, found, [OVERSAMPLE * f.fit.k for f in found], number, seed)
    def reduced(given):
        fit, candidates, weight = given
        k, d = fit.k, candidates.shape[1]
        rng = np.random.default_rng([seed, k, fit.start, 0 if fit.resample is None else fit.resample + 1])
        centres = _reduced(candidates, weight, k, rng) if weight.sum() > 0 else np.zeros((0, d))
        while len(centres) < k:                     # fewer different points than centres: repeat one
            centres = np.vstack([centres, centres[-1] if len(centres) else np.zeros(d)])
        return centres

    given = [(f.fit, f.centres, weight) for f, weight in zip(found, _candidate_weights(points, found))]
    tasks = min(len(given), 4 * points.context.defaultParallelism)
    for f, centres in zip(found, points.context.parallelize(given, tasks).map(reduced).collect()):
        f.centres = centres


# rows of all tasks together up to which partial results come to the driver as they are; beyond, they are combined in an exchange first
DIRECT_ROWS = 20_000


def _gathered(points: RDD, work, rows_per_task: int, add=np.add):
    """The tasks' partial results added up, in the order of the tasks; many of them are added in an exchange before they come to the driver."""
    parts = points.mapPartitions(work)
    if rows_per_task * points.getNumPartitions() > DIRECT_ROWS:
        return parts.treeReduce(add)
    return reduce(add, parts.collect())


# how far a centre may still move when a start is compared with the others, and when a fit ends, in deviations
COMPARED, ENDED = 1e-2, 1e-4

STRIP_WORK = 32_768     # distances that are held at once while sums are taken
SAMPLED = 64            # customers of a block by whose leads it is estimated how many are undecided
LEADS = 4 * 2.0 ** (-np.arange(24) / 2)         # rooms that are tried, from the largest


def _sums(x: np.ndarray, weights: list[np.ndarray | None], centres: list[np.ndarray], rooms: list[float] | None = None,
          sample: bool = False) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Weight, weighted square and weighted sum of each centre's points, a row for each centre, fit after fit. Fits with the same weights are
    worked out together; points without weight aren't.

    With ``rooms`` the undecided points are left out, those whose nearest centre leads by no more than twice the fit's room; their places are
    returned for each fit. With ``sample`` there is a row for each fit: points, those of a sample, and how many of these lead by no more than twice each of
    ``LEADS``.
    """
    first, together = np.cumsum([0, *map(len, centres)]), {}
    for i, weight in enumerate(weights):
        together.setdefault(id(weight), {}).setdefault(len(centres[i]), []).append(i)
    with_ones = np.column_stack([np.ones(len(x)), (x ** 2).sum(axis=1), x])
    total, leads = np.zeros((first[-1], with_ones.shape[1])), np.zeros((len(centres), 2 + len(LEADS)))
    undecided: list[list[np.ndarray]] = [[] for _ in centres]
    for by_size in together.values():
        weight = weights[next(iter(by_size.values()))[0]]
        some = np.arange(len(x)) if weight is None else np.flatnonzero(weight)
        mine = with_ones if weight is None else with_ones.take(some, axis=0)
        weighted = mine if weight is None else mine * weight[some, None]
        for k, group in by_size.items():
            most = max(1, 256 // k)
            for part in (group[i:i + most] for i in range(0, len(group), most)):
                at = np.concatenate([centres[i] for i in part])
                factors = np.column_stack([(at ** 2).sum(axis=1), np.zeros(len(at)), -2 * at])
                found, strip = np.zeros((len(at), with_ones.shape[1])), max(64, STRIP_WORK // len(at))
                held, flags, numbers = (np.empty(len(at) * strip, t) for t in (float, bool, float))      # used again for every strip
                for start in range(0, len(some), strip):
                    rows = mine[start:start + strip]
                    away, nearest, member = (a[:len(at) * len(rows)].reshape(len(part), k, -1) for a in (held, flags, numbers))
                    np.matmul(factors, rows.T, out=away.reshape(len(at), -1))   # squared distances but for the points' own squares
                    least = away.min(axis=1)
                    np.equal(away, least[:, None], out=nearest)
                    if np.count_nonzero(nearest) != len(part) * len(rows):   # equally near: the first counts
                        nearest = away.argmin(axis=1)[:, None] == np.arange(k)[:, None]
                    np.copyto(member, nearest)
                    if rooms is not None:
                        unsure = _leads(away, least, nearest, rows[:, 1]) <= 2 * np.array([rooms[i] for i in part])[:, None]
                        member *= ~unsure[:, None]
                        for i, places in zip(part, unsure):
                            undecided[i].append(some[start + np.flatnonzero(places)])
                    if sample and start == 0:
                        seen = slice(0, SAMPLED)
                        lead = _leads(away[..., seen], least[:, seen], nearest[..., seen], rows[seen, 1])
                        leads[part, 0], leads[part, 1] = len(some), lead.shape[1]
                        leads[part, 2:] = (lead[..., None] <= 2 * LEADS).sum(axis=1)
                    found += member.reshape(len(at), -1) @ weighted[start:start + strip]
                for n, i in enumerate(part):
                    total[first[i]:first[i + 1]] = found[n * k:(n + 1) * k]
    return total, [np.concatenate(places or [np.zeros(0, np.int64)]) for places in undecided], leads


def _leads(away: np.ndarray, least: np.ndarray, nearest: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """(fits, points): how much nearer the nearest centre is than the second one."""
    second = np.where(nearest, np.inf, away).min(axis=1)
    return np.sqrt(np.maximum(0, second + squares)) - np.sqrt(np.maximum(0, least + squares))


def _costs(sums: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Weighted squared distances of each centre's points, from their sums."""
    return np.maximum(0, sums[:, 1] - 2 * (centres * sums[:, 2:]).sum(axis=1) + (centres ** 2).sum(axis=1) * sums[:, 0])


def _cluster_sums(x: np.ndarray, weights: list[np.ndarray | None], centres: list[np.ndarray], total: np.ndarray) -> None:
    """Add weight, weighted squared distance and weighted sum of each centre's points to its row of ``total``, fit after fit."""
    sums = _sums(x, weights, centres)[0]
    sums[:, 1] = _costs(sums, np.concatenate(centres))
    total += sums


def _stepped(sums: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The means, which are the new centres, and how far each lies from the old one. A centre without points stays."""
    means = np.where(sums[:, :1] > 0, sums[:, 2:] / np.maximum(sums[:, :1], 1e-300), centres)
    return means, np.sqrt(((means - centres) ** 2).sum(axis=1))


def _weights(w: np.ndarray, resamples: list[int | None]) -> list[np.ndarray | None]:
    """Each fit's weights; fits of one resample have the same array."""
    drawn = {r: w[:, r].astype(float) for r in set(resamples) if r is not None}
    return [drawn.get(r) for r in resamples]


def _one_step(points: RDD, moving: list[Centres], tolerance: float, most: int) -> None:
    """Labels and new means for all fits in one pass. A row for each fit, cluster and task is shuffled, the means come to the driver."""
    sizes, resamples, slow = [len(f.centres) for f in moving], [f.fit.resample for f in moving], min(f.far for f in moving) <= SLOW
    old, first = np.vstack([f.centres for f in moving]), np.cumsum([0, *sizes])
    width = old.shape[1] + 2

    def sums(blocks):
        centres = [old[one:other] for one, other in zip(first, first[1:])]
        total, seen = np.zeros((len(old), width)), np.zeros((len(sizes), 2 + len(LEADS)))
        for _, x, w in blocks:
            found, _, leads = _sums(x, _weights(w, resamples), centres, sample=slow)
            total += found
            seen += leads
        yield np.concatenate([total.ravel(), seen.ravel()])

    table, seen = np.split(_gathered(points, sums, sum(sizes)), [sum(sizes) * width])
    table, seen = table.reshape(-1, width), seen.reshape(len(sizes), -1)
    means, away = _stepped(table, old)
    moved, costs = np.maximum.reduceat(away, first[:-1]), np.add.reduceat(_costs(table, old), first[:-1])
    for f, at, end, far, cost, leads in zip(moving, first, first[1:], moved, costs, seen):
        f.far, f.cost, f.sizes, f.steps, f.settled = float(far), float(cost), table[at:end, 0], f.steps + 1, bool(far <= tolerance)
        if not f.settled:
            f.centres, f.room = means[at:end], _room(leads, f.far, end - at, most)


# Once centres move little, most customers can't change theirs: where the nearest leads the second by more than twice the room, labels
# stay until a centre is farther than the room from where it was. Their sums are taken once, and the few undecided customers of a fit go
# to one task, which makes as many steps as the room allows. The steps are those of full passes.
UNDECIDED = (8_000_000, 65_536)         # about the most undecided customers of all fits, and of one
SENT = 150              # what sending an undecided customer costs, in distances
TOGETHER = 4            # fits with room wait while there are so many times more without
SLOW = 0.1              # a movement below which room is looked for
MANY = 50               # steps that a room without end is expected to save, and the most that any is
INNER = 8               # movements of the room within a task


def _room(leads: np.ndarray, far: float, k: int, most: int) -> float:
    """The room that saves most: steps it is expected to allow, less two for the pass, less what its undecided customers cost. Zero if none does."""
    if far > SLOW or not leads[1]:
        return 0.0
    customers, undecided = leads[0], np.append(leads[2:] / leads[1], 1.0) * leads[0]
    rooms = np.append(LEADS, np.inf)
    saved = np.minimum(rooms / max(far, 1e-300), MANY) - 2 - SENT * undecided / (k * customers)
    best = int(np.where(undecided <= most, saved, -np.inf).argmax())
    return float(rooms[best]) if undecided[best] <= most and saved[best] > 0 else 0.0


def _settled_within(sure: np.ndarray, x: np.ndarray, weight: np.ndarray, start: np.ndarray, room: float, steps: int, tolerance: float,
                    max_steps: int) -> tuple:
    """Steps of one fit over its undecided customers, until it ends or a centre leaves the room: centres, cost, sizes, steps, whether it ended, last
    movement. Customers that are decided for a few more steps are summed once, too."""
    def away(centres, other):
        return np.sqrt(((centres - other) ** 2).sum(axis=1)).max()

    at, far, near, inner, decided, mine, own = start, 0.0, start, 0.0, sure, x, weight
    while True:
        if away(at, near) > inner:
            near, inner = at, INNER * far
            found, (some,), _ = _sums(x, [weight], [at], [inner])
            decided, mine, own = sure + found, x[some], weight[some]
        sums = decided + _sums(mine, [own], [at])[0]
        means, moved = _stepped(sums, at)
        far = float(moved.max())
        cost, steps, settled = float(_costs(sums, at).sum()), steps + 1, far <= tolerance
        if not settled:
            at = means
        if settled or steps >= max_steps or away(at, start) > room:
            return at, cost, sums[:, 0], steps, settled, far


def _steps_within(points: RDD, moving: list[Centres], tolerance: float, most: int, max_steps: int) -> None:
    """Steps of fits that have room, all in one pass: each until it ends or a centre leaves the room."""
    fits = [(f.centres, f.room, f.steps) for f in moving]
    centres, rooms, resamples = [f.centres for f in moving], [f.room for f in moving], [f.fit.resample for f in moving]
    first = np.cumsum([0, *map(len, centres)])

    def decided(task, blocks):
        total, seen, held, rows, sent = 0.0, 0.0, [[] for _ in centres], 0, 0
        for _, x, w in blocks:
            weights = _weights(w, resamples)
            found, places, leads = _sums(x, weights, centres, rooms, sample=True)
            total, seen = total + found, seen + leads
            for i, at in enumerate(places):
                if len(at):
                    held[i].append(np.column_stack([np.ones(len(at)) if weights[i] is None else weights[i][at], x[at]]))
                    rows += len(at)
            if rows > UNDECIDED[1]:
                yield from ((i, (task, sent, np.concatenate(some))) for i, some in enumerate(held) if some)
                held, rows, sent = [[] for _ in centres], 0, sent + 1
        yield from ((i, (task, sent, np.concatenate(some))) for i, some in enumerate(held) if some)
        if not isinstance(total, float):
            yield from ((i, (task, -1, (total[first[i]:first[i + 1]], seen[i]))) for i in range(len(centres)))

    def finish(sent):
        parts: dict[int, list] = {}
        for i, part in sent:
            parts.setdefault(i, []).append(part)
        for i, mine in parts.items():
            mine.sort(key=lambda part: part[:2])                  # the same sums whichever part came first
            sure, leads = (sum(v) for v in zip(*(part[2] for part in mine if part[1] < 0)))
            rows = [part[2] for part in mine if part[1] >= 0]
            unsure = np.concatenate(rows) if rows else np.zeros((0, 1 + len(fits[i][0][0])))
            *end, far = _settled_within(sure, np.ascontiguousarray(unsure[:, 1:]), unsure[:, 0].copy(), *fits[i], tolerance, max_steps)
            yield i, *end, far, _room(leads, far, len(fits[i][0]), most)

    tasks = min(len(moving), 8 * points.context.defaultParallelism)
    for i, *end in points.mapPartitionsWithIndex(decided).partitionBy(tasks).mapPartitions(finish).collect():
        f = moving[i]
        f.centres, f.cost, f.sizes, f.steps, f.settled, f.far, f.room = end


def _move(points: RDD, found: list[Centres], tolerance: float, max_steps: int) -> None:
    """Each pass over the customers takes all fits one step further, or as many as their room allows. A fit ends when no centre moves by more
    than the tolerance."""
    for f in found:
        f.settled, f.steps, f.room, f.far = False, 0, 0.0, math.inf
    while moving := [f for f in found if not f.settled and f.steps < max_steps]:
        most = max(1, min(UNDECIDED[0] // len(moving), UNDECIDED[1]))
        far, near = [f for f in moving if not f.room], [f for f in moving if f.room]
        if len(far) >= TOGETHER * len(near):
            near = []                                            # they wait until there are more
        if far:
            _one_step(points, far, tolerance, most)
        if near:
            _steps_within(points, near, tolerance, most, max_steps)


def fit_all(points: DataFrame, fits: list[Fit], seed: int = SEED, max_steps: int = 300) -> list[Centres]:
    """All fits together, each to its end."""
    d, blocks = len(points.first()["x"]), packed(points, sum(f.k for f in fits))
    found = [Centres(f, np.zeros((0, d))) for f in fits]
    _start(blocks, found, seed)
    _move(blocks, found, ENDED, max_steps)
    blocks.unpersist()
    return found


def fit_best(points: DataFrame, fits: list[Fit], seed: int = SEED, max_steps: int = 300) -> dict[tuple[int, int | None], Centres]:
    """The cheapest start for each (k, resample): all starts move until they can be compared, the cheapest ones go on to the end."""
    d, blocks = len(points.first()["x"]), packed(points, sum(f.k for f in fits))
    found = [Centres(f, np.zeros((0, d))) for f in fits]
    _start(blocks, found, seed)
    _move(blocks, found, COMPARED, max_steps)
    best = best_of(found)
    _move(blocks, list(best.values()), ENDED, max_steps)
    blocks.unpersist()
    return best


def best_of(found: list[Centres]) -> dict[tuple[int, int | None], Centres]:
    """The cheapest start for each (k, resample)."""
    best: dict[tuple[int, int | None], Centres] = {}
    for f in found:
        key = (f.fit.k, f.fit.resample)
        if key not in best or f.cost < best[key].cost:
            best[key] = f
    return best


def fit_kmeans(matrix: DataFrame, k: int, n_init: int = 10, seed: int = SEED) -> Centres:
    """The best of ``n_init`` starts by the sum of squared distances."""
    points = fit_points(matrix)
    best = fit_best(points, [Fit(k, s) for s in range(n_init)], seed)
    points.unpersist()
    return best[k, None]


def agreement(points: DataFrame, labellers: list, pairs: list[tuple[int, int, int]]) -> DataFrame:
    """(rep, ari) for each (rep, one labeller, another): everybody is labelled once by each of them, pairs of labels are counted in tasks."""
    def count(batches):
        total: dict[tuple[int, int, int], int] = {}
        for _, x, _ in _blocks(batches):
            labels = [m.labels(x).astype(np.int64) for m in labellers]
            for rep, one, other in pairs:
                width = int(labels[other].max()) + 1
                code, times = np.unique(labels[one] * width + labels[other], return_counts=True)
                for v, t in zip(code.tolist(), times.tolist()):
                    key = (rep, *divmod(v, width))
                    total[key] = total.get(key, 0) + t
        rows = [(*key, t) for key, t in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         names=["rep", "a", "b", "c"])

    counted = points.select("h", "x", "w").mapInArrow(count, "rep int, a int, b int, c long")
    return stats.adjusted_rand(counted, "a", "b", ("rep",), "c")


def resample_agreement(points: DataFrame, reference: Centres, resampled: list[Centres]) -> DataFrame:
    """(rep, ari): everybody is labelled by the reference and by each resample's centres."""
    return agreement(points, [reference, *resampled], [(f.fit.resample, 0, i) for i, f in enumerate(resampled, 1)])


def bootstrap_ari(matrix: DataFrame, reference: Centres, k: int, n_boot: int = 100, n_init: int = 5, seed: int = SEED) -> DataFrame:
    """Refit on ``n_boot`` resamples, each with ``n_init`` starts, and compare the labels of all customers with the reference."""
    points = fit_points(matrix, n_boot, seed)
    best = fit_best(points, [Fit(k, s, r) for r in range(n_boot) for s in range(n_init)], seed)
    return resample_agreement(points, reference, [best[k, r] for r in range(n_boot)])       # lazy, so the points stay kept


def stability(ari: DataFrame) -> DataFrame:
    return ari.agg(F.avg("ari").alias("bootstrap_ari_mean"), F.percentile("ari", 0.05).alias("bootstrap_ari_p05"))


# --- mixtures --------------------------------------------------------------

FLOOR = 1e-3                            # fixed value: what is added to every variance of a component
MIXTURE_WORK = 16                       # what a component costs of a pass, in centres
MIXTURE_ENDED, MIXTURE_STEPS = 1e-3, 100   # gain of the mean log-likelihood at which a fit ends, and the most passes


@dataclass
class Mixture:
    """A full-covariance Gaussian mixture. ``factors`` are the inverted Cholesky factors of the covariances, None before the first step,
    in which customers belong to the nearest mean alone. ``trace`` holds the mean log-likelihood of every pass."""
    k: int
    start: int
    means: np.ndarray
    shares: np.ndarray | None = None
    covariances: np.ndarray | None = None
    factors: np.ndarray | None = None
    trace: list[float] = field(default_factory=list)
    settled: bool = False

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """(customers, components): log of a component's share times its density."""
        out = np.empty((len(x), self.k))
        for c, (mean, factor) in enumerate(zip(self.means, self.factors)):
            scaled = (x - mean) @ factor.T
            out[:, c] = np.log(np.diag(factor)).sum() - 0.5 * (scaled ** 2).sum(axis=1)
        return out + np.log(np.maximum(self.shares, 1e-300)) - 0.5 * x.shape[1] * math.log(2 * math.pi)

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """How much of each customer belongs to each component, and the log-likelihood of the customers together."""
        if self.factors is None:
            return np.eye(self.k)[_nearest(x, self.means)[0]], 0.0
        logs = self.log_densities(x)
        top = logs.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
        return np.exp(logs - total), float(total.sum())

    def labels(self, x: np.ndarray) -> np.ndarray:
        return self.log_densities(x).argmax(axis=1)

    def update(self, moments: np.ndarray) -> None:
        """New parameters from a row (weight, log-likelihood, first moments, upper triangle of the second ones) for each component, moments
        about its present mean."""
        d = self.means.shape[1]
        weight = moments[:, 0] + 10 * np.finfo(float).eps
        shift = moments[:, 2:2 + d] / weight[:, None]
        upper = np.triu_indices(d)
        covariances = np.empty((self.k, d, d))
        for c in range(self.k):
            second = np.zeros((d, d))
            second[upper] = moments[c, 2 + d:] / weight[c]
            covariances[c] = second + np.triu(second, 1).T - np.outer(shift[c], shift[c]) + FLOOR * np.eye(d)
        self.means, self.shares, self.covariances = self.means + shift, weight / weight.sum(), covariances
        self.factors = np.array([np.linalg.inv(np.linalg.cholesky(v)) for v in covariances])

    def bic(self, customers: int) -> float:
        d = self.means.shape[1]
        free = (self.k - 1) + self.k * d + self.k * d * (d + 1) / 2
        return -2 * self.trace[-1] * customers + free * math.log(customers)


def _moments(points: RDD, moving: list[Mixture]) -> list[np.ndarray]:
    """One pass for all mixtures: the moments of every component, added in numpy per task. Their size doesn't grow with customers."""
    d = moving[0].means.shape[1]
    upper, width = np.triu_indices(d), 2 + d + d * (d + 1) // 2
    ends = np.cumsum([m.k for m in moving])

    def sums(blocks):
        total = [np.zeros((m.k, width)) for m in moving]
        for _, x, _ in blocks:
            for m, t in zip(moving, total):
                shared, likelihood = m.responsibilities(x)
                t[0, 1] += likelihood
                for c in range(m.k):
                    away, r = x - m.means[c], shared[:, c]
                    t[c, 0] += r.sum()
                    t[c, 2:2 + d] += r @ away
                    t[c, 2 + d:] += ((away * r[:, None]).T @ away)[upper]
        yield np.concatenate(total)

    rows = sum(m.k for m in moving) * max(1, width // 16)      # wide rows: combined in an exchange earlier than those of K-means
    return np.split(_gathered(points, sums, rows), ends[:-1])


def fit_all_mixtures(points: DataFrame, ks, n_init: int = 3, seed: int = SEED) -> list[Mixture]:
    """``n_init`` mixtures for each k, all in one batch: they start from K-means clusters, a step is one pass for all that still gain.

    A mixture keeps the parameters to which the last value of its trace belongs. Components may stay empty where there are fewer
    different customers than components.
    """
    starts = [Centres(Fit(k, s), np.zeros((0, len(points.first()["x"])))) for k in ks for s in range(n_init)]
    blocks = packed(points, MIXTURE_WORK * sum(f.fit.k for f in starts))
    _start(blocks, starts, seed)
    _move(blocks, starts, COMPARED, MIXTURE_STEPS)
    found = [Mixture(f.fit.k, f.fit.start, f.centres) for f in starts]
    for step in range(MIXTURE_STEPS + 1):
        moving = [m for m in found if not m.settled]
        if not moving:
            break
        for m, moments in zip(moving, _moments(blocks, moving)):
            if m.factors is not None:
                m.trace.append(float(moments[0, 1] / moments[:, 0].sum()))
                gain = m.trace[-1] - m.trace[-2] if len(m.trace) > 1 else math.inf
                m.settled = abs(gain) < MIXTURE_ENDED or step == MIXTURE_STEPS
            if not m.settled:
                m.update(moments)
    blocks.unpersist()
    return found


def likeliest(found: list[Mixture]) -> dict[int, Mixture]:
    """The most likely start for each k, of equal ones the first."""
    return {k: max((m for m in found if m.k == k), key=lambda m: m.trace[-1]) for k in dict.fromkeys(m.k for m in found)}


def component_sizes(points: DataFrame, model: Mixture) -> DataFrame:
    """(component, customers): everybody counts for the likeliest component; components without anybody are left out."""
    def count(batches):
        total = np.zeros(model.k, np.int64)
        for _, x, _ in _blocks(batches):
            total += np.bincount(model.labels(x), minlength=model.k)
        yield pa.RecordBatch.from_arrays([pa.array(range(model.k), pa.int32()), pa.array(total)], names=["component", "n"])

    counted = points.select("h", "x", "w").mapInArrow(count, "component int, n long")
    return counted.groupBy("component").agg(F.sum("n").alias("customers")).where("customers > 0")


# --- choice of k -----------------------------------------------------------

def squared_silhouette(labelled: DataFrame, label: str = "cluster") -> float:
    """Silhouette on squared Euclidean distance, which needs cluster sums only and no pairs of customers."""
    return ClusteringEvaluator(featuresCol="x", predictionCol=label).evaluate(labelled)


def labelled_points(points: DataFrame, labellers: list) -> DataFrame:
    """(x, labels): the number that each labeller gives to a customer, kept for the passes of the silhouette."""
    def label(batches):
        for _, x, _ in _blocks(batches):
            given = np.column_stack([m.labels(x) for m in labellers])
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(given.tolist(), pa.list_(pa.int32()))],
                                             names=["x", "labels"])

    return points.select("h", "x", "w").mapInArrow(label, "x array<double>, labels array<int>").persist(StorageLevel.MEMORY_AND_DISK)


K_TABLE_LEAVES = 1024       # leaves of the silhouette's tree in the k table, which scores all k at once

# Names of the result columns.
K_TABLE = ("k int, inertia double, silhouette double, silhouette_error double, silhouette_squared double, bootstrap_ari_mean double, "
           "bootstrap_ari_p05 double, "
           "smallest_segment long, gmm_bic double, gmm_vs_kmeans_ari double")


def select_k(matrix: DataFrame, ks=config.K_RANGE, n_init: int = 10, n_boot: int = 100, boot_init: int = 5,
             mixture_init: int = 3) -> DataFrame:
    """One row of fit and stability measures per k. All K-means fits of all k are one batch, and all mixtures another."""
    n = matrix.count()
    points = fit_points(matrix, n_boot)
    fits = [Fit(k, s) for k in ks for s in range(n_init)] + [Fit(k, s, r) for k in ks for r in range(n_boot) for s in range(boot_init)]
    best = fit_best(points, fits)
    mixtures, rows = likeliest(fit_all_mixtures(points, ks, mixture_init)), []
    both = [m for k in ks for m in (best[k, None], mixtures[k])]
    agree = {r["rep"]: r["ari"] for r in agreement(points, both, [(k, 2 * i, 2 * i + 1) for i, k in enumerate(ks)]).collect()}
    with_labels = labelled_points(points, [best[k, None] for k in ks])
    plain = {r["labelling"]: r for r in silhouette.overall(silhouette.silhouettes(with_labels, list(ks), K_TABLE_LEAVES)).collect()}
    with_labels.unpersist()
    for i, k in enumerate(ks):
        model, labelled = best[k, None], best[k, None].transform(matrix)
        steady = stability(resample_agreement(points, model, [best[k, r] for r in range(n_boot)])).first()
        rows.append((k, model.cost, plain[i]["silhouette"], plain[i]["silhouette_error"], float(squared_silhouette(labelled)),
                     steady[0], steady[1], int(model.sizes.min()),
                     mixtures[k].bic(n), agree[k]))
    points.unpersist()
    table = matrix.sparkSession.createDataFrame(rows, K_TABLE)
    previous = F.lag("inertia").over(Window.orderBy("k"))
    return table.withColumn("inertia_drop_pct", 1 - F.col("inertia") / previous)


# --- labels ----------------------------------------------------------------

def segment_features(features: DataFrame, matrix: DataFrame, model) -> DataFrame:
    """Features with segment_id, numbered from the highest spend."""
    labels = model.transform(matrix).select("customer_id", "cluster")
    return segments.order_by_spend(features.join(labels, "customer_id"), "cluster").drop("cluster")


def project(matrix: DataFrame, k: int = 2):
    """(coordinates, explained variance): the first principal components per customer. A component's largest loading is positive."""
    model = PCA(k=k, inputCol="x", outputCol="pc").fit(matrix)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    coordinates = model.transform(matrix).withColumn("pc", vector_to_array("pc")).select(
        "customer_id", *[(F.get("pc", F.lit(i)) * float(signs[i])).alias(f"pca_{i + 1}") for i in range(k)])
    return coordinates, [float(v) for v in model.explainedVariance]


def assignments(segmented: DataFrame, profiles: DataFrame, coordinates: DataFrame) -> DataFrame:
    names = profiles.select("segment_id", "segment_name")
    return (segmented.select("customer_id", "segment_id", "generation")
            .join(F.broadcast(names), "segment_id")            # one row per segment
            .join(coordinates, "customer_id")
            .select("customer_id", "segment_id", "segment_name", "generation", "pca_1", "pca_2"))


# --- artifact check --------------------------------------------------------

def stratified_folds(df: DataFrame, stratum: str, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold``: within a stratum customers take turns in the order of a hash.

    The order number is the place within a hash range plus the rows of the lower ranges, so no task sorts a whole
    stratum. The offsets are 256 rows per stratum.
    """
    hashed = (df.withColumn("_h", C.hash32(F.lit(seed), "customer_id"))
              .withColumn("_b", F.shiftright("_h", 24)))
    lower = Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (hashed.groupBy(stratum, "_b").agg(F.count("*").alias("n"))
               .select(stratum, "_b", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("_before")))
    place = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", "customer_id"))
    return (hashed.withColumn("_place", place).join(F.broadcast(offsets), [stratum, "_b"])
            .withColumn("fold", ((F.col("_before") + F.col("_place") - 1) % folds).cast("int"))
            .drop("_h", "_b", "_before", "_place"))


def attribute_associations(labelled: DataFrame, label: str) -> DataFrame:
    """Cramer's V of the segment with the five attributes it was not built from."""
    # fixed values: names of the attributes in the result
    attributes = {"generation": "generation", "inferred_age_band": "age_band", "gender": "gender",
                  "city_size_band": "city_size_band", "transactions_per_day_tier": "txns_per_day_tier"}
    # every attribute has a handful of values, so their combinations are counted once
    counted = labelled.groupBy(label, *attributes.values()).agg(F.count("*").alias("c"))
    pairs = F.array(*[F.struct(F.lit(name).alias("attribute"), F.col(c).cast("string").alias("value"))
                      for name, c in attributes.items()])
    return stats.chi_square(counted.select(label, "c", F.inline(pairs)), ["attribute"], label, "value", "c")


PREDICTORS = ("birth_year", "is_female", "log_city_pop")


def predictor_columns(labelled: DataFrame) -> DataFrame:
    return (labelled.withColumn("is_female", (F.col("gender") == "F").cast("int"))
            .withColumn("log_city_pop", F.log10("city_pop")))


DEEPEST = 30       # of a tree


def forest_inputs(labelled: DataFrame, label: str = "segment_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """(customer_id, v, fold, y): predictors as a vector (demographics and ``extra`` columns), kept for the forests. ``unpersist`` it afterwards.

    Labels are numbers from 1.
    """
    vectors = VectorAssembler(inputCols=[*PREDICTORS, *extra], outputCol="v").transform(stratified_folds(predictor_columns(labelled), label))
    return vectors.select("customer_id", "v", "fold", (F.col(label) - 1).cast("double").alias("y")).persist(StorageLevel.MEMORY_AND_DISK)


def out_of_fold(inputs: DataFrame, trees: int = 300, depth: int = DEEPEST, seed: int = SEED) -> DataFrame:
    """(customer_id, fold, label, predicted): everybody is predicted once, by the forest that hasn't seen the customer's fold."""
    return forest.out_of_fold(inputs, trees, depth, seed).select(
        "customer_id", "fold", *[(F.col(c) + 1).cast("long").alias(name) for c, name in (("y", "label"), ("predicted", "predicted"))])


def forest_accuracy(labelled: DataFrame, label: str = "segment_id", extra: tuple[str, ...] = (), trees: int = 300,
                    depth: int = DEEPEST, seed: int = SEED) -> float:
    """Mean cross-validated accuracy of predicting the segment from demographics (and ``extra`` columns)."""
    inputs = forest_inputs(labelled, label, extra)
    right = (F.col("predicted") == F.col("label")).cast("int")
    hits = out_of_fold(inputs, trees, depth, seed).groupBy("fold").agg(F.avg(right).alias("hit_rate"))
    accuracy = hits.agg(F.avg("hit_rate")).first()[0]
    inputs.unpersist()
    return accuracy


def artifact_check(labelled: DataFrame, label: str = "segment_id", trees: int = 300, depth: int = DEEPEST) -> DataFrame:
    """How much of the segments demographics alone explain, as one row."""
    demographics = forest_accuracy(labelled, label, (), trees, depth)
    with_tier = forest_accuracy(labelled, label, ("txns_per_day_tier",), trees, depth)
    return segments.majority_share(labelled, label).select(
        "majority_baseline_accuracy", F.lit(demographics).alias("demographics_only_accuracy"),
        F.lit(with_tier).alias("demographics_plus_frequency_tier_accuracy"))
