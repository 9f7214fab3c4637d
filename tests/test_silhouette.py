"""Silhouette by cells against all pairs."""
import numpy as np
import pytest

from spendweave.operators import silhouette


def by_pairs(x, label):
    """All distances; the only member of a label scores zero."""
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(label):
        mates = (label == own).sum() - 1
        inner = distance[i, label == own].sum() / max(mates, 1)
        outer = min(distance[i, label == c].mean() for c in set(label) - {own})
        out.append(0.0 if mates == 0 or max(inner, outer) == 0 else (outer - inner) / max(inner, outer))
    return np.array(out)


def frame(spark, x, *labels):
    rows = [(v.tolist(), [int(c[i]) for c in labels]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "x array<double>, labels array<int>").repartition(4).cache()


def planted(n=400, d=4, seed=3):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, n)
    return rng.normal(0, 1, (n, d)) + label[:, None] * 2.0, label, rng.integers(0, 4, n)


def test_one_customer_a_leaf_is_exact(spark):
    x, good, random = planted()
    x[7] = x[8] = x[9]                                        # equal points
    got = silhouette.silhouettes(frame(spark, x, good, random), [3, 4]).collect()
    for t, label in enumerate((good, random)):
        want = by_pairs(x, label)
        for r in (r for r in got if r["labelling"] == t):
            assert r["customers"] == (label == r["label"]).sum()
            assert r["silhouette"] == pytest.approx(want[label == r["label"]].mean(), abs=1e-6)
            assert r["at_most"] - r["at_least"] < 1e-5


@pytest.mark.parametrize("leaves", [1, 8, 64])
def test_few_leaves_keep_the_exact_result_in_bounds(spark, leaves):
    x, good, random = planted()
    points = frame(spark, x, good, random)
    by_label = silhouette.silhouettes(points, [3, 4], leaves)
    want = [by_pairs(x, label) for label in (good, random)]
    for r in by_label.collect():
        exact = want[r["labelling"]][(good, random)[r["labelling"]] == r["label"]].mean()
        assert r["at_least"] - 1e-9 <= exact <= r["at_most"] + 1e-9
        assert r["at_least"] <= r["silhouette"] <= r["at_most"]
    for r in silhouette.overall(by_label).collect():
        assert abs(r["silhouette"] - want[r["labelling"]].mean()) <= min(r["silhouette_error"], 0.04)


def test_more_leaves_narrow_the_bounds(spark):
    x, good, _ = planted()
    points = frame(spark, x, good)
    errors = [silhouette.overall(silhouette.silhouettes(points, [3], n)).first()["silhouette_error"] for n in (1, 32, 400)]
    assert errors == sorted(errors, reverse=True) and errors[-1] < 1e-5


def test_hot_point_far_from_the_origin(spark):
    """A third of all rows are one point; coordinates are large against their differences."""
    x, good, _ = planted(300)
    x[:100], good[:100] = x[0], good[0]
    got = silhouette.silhouettes(frame(spark, x + 1e5, good), [3]).collect()
    want = by_pairs(x, good)
    for r in got:
        assert r["silhouette"] == pytest.approx(want[good == r["label"]].mean(), abs=1e-6)


def test_edges(spark):
    none = spark.createDataFrame([], "x array<double>, labels array<int>")
    assert silhouette.silhouettes(none, [2]).count() == 0
    one_label = silhouette.silhouettes(frame(spark, np.arange(6.0).reshape(3, 2), [0, 0, 0]), [2]).collect()
    assert [(r["label"], r["customers"], r["silhouette"]) for r in one_label] == [(0, 3, None)]
    alone = silhouette.silhouettes(frame(spark, np.array([[0.0], [1.0], [5.0]]), [0, 0, 1]), [2]).collect()
    assert {r["label"]: r["silhouette"] for r in alone} == pytest.approx({0: (4 / 5 + 3 / 4) / 2, 1: 0.0})
    same = silhouette.silhouettes(frame(spark, np.zeros((4, 2)), [0, 0, 1, 1]), [2]).collect()
    assert [r["silhouette"] for r in same] == [0.0, 0.0]


def test_tasks_follow_the_distances(spark, monkeypatch):
    """A table that lies in one task is scored in as many as its distances ask for, with the same result."""
    x, good, random = planted()
    points = frame(spark, x, good, random).coalesce(1).cache()
    cells = silhouette._cells(points, silhouette.grow(points, 4, 64), [3, 4])
    work = len(x) * sum(len(c.n) for c in cells)
    before = sorted(silhouette.silhouettes(points, [3, 4], 64).collect())
    monkeypatch.setattr(silhouette, "TASK_DISTANCES", work // 6)
    assert silhouette.spread_out(points, cells).rdd.getNumPartitions() in (6, 7)
    after = sorted(silhouette.silhouettes(points, [3, 4], 64).collect())
    assert [r[:3] for r in after] == [r[:3] for r in before]
    assert [v for r in after for v in r[3:]] == pytest.approx([v for r in before for v in r[3:]])


def test_cells_of_several_blocks(monkeypatch):
    """Sums of distances are those of the plain formula when a label's cells fill several blocks, with and without spread."""
    monkeypatch.setattr(silhouette, "BLOCK", (8, 16))
    rng = np.random.default_rng(2)
    mean, label, n = rng.normal(0, 1, (100, 3)), rng.integers(0, 3, 100), rng.integers(1, 9, 100).astype(float)
    variance = rng.random((100, 3)) * (rng.random(100) < 0.5)[:, None]
    x = rng.normal(0, 1, (20, 3))
    x[0] = mean[0]
    low, about, high = silhouette.Cells(n, mean, variance, label, 3).distances(x)
    squared = ((x[:, None] - mean) ** 2).sum(-1)
    along = np.divide(((x[:, None] - mean) ** 2 * variance).sum(-1), squared, out=np.zeros_like(squared), where=squared > 1e-12)
    for c in range(3):
        own, s, t, v = label == c, squared, variance.sum(1), along
        for got, want in ((low, s), (about, s + t - v), (high, s + t)):
            assert got[:, c] == pytest.approx(np.sqrt(want)[:, own] @ n[own], abs=1e-6)


def along_a_line(x, label):
    """Silhouettes of points on a line, from sums over sorted points."""
    mean = []
    for c in range(label.max() + 1):
        y = np.sort(x[label == c])
        before, sums = np.searchsorted(y, x), np.r_[0, np.cumsum(y)]
        total = x * before - sums[before] + sums[-1] - sums[before] - x * (len(y) - before)
        mean.append(total / (len(y) - (label == c)))
    mean, at = np.array(mean), np.arange(len(x))
    inner = mean[label, at].copy()
    mean[label, at] = np.inf
    outer = mean.min(axis=0)
    return (outer - inner) / np.maximum(inner, outer)


def test_more_customers_than_any_tree_had_leaves(spark):
    """40,000 different points are scored by all pairs: no bounds are left. A tree of 32,768 leaves was the most before."""
    rng = np.random.default_rng(8)
    label = rng.integers(0, 3, 40_000)
    x = rng.normal(0, 1, len(label)) + label
    want = along_a_line(x, label)
    got = silhouette.silhouettes(frame(spark, x[:, None], label), [3]).collect()
    assert sorted(r["label"] for r in got) == [0, 1, 2]
    for r in got:
        assert r["customers"] == (label == r["label"]).sum() and r["at_least"] == r["at_most"] == r["silhouette"]
        assert r["silhouette"] == pytest.approx(want[label == r["label"]].mean(), abs=1e-9)


@pytest.mark.parametrize("rows", [400, 10])
def test_all_pairs_do_not_depend_on_the_blocks(spark, monkeypatch, rows):
    """Few and many blocks, more of them than some have points for, and tiles that cut blocks anywhere."""
    monkeypatch.setattr(silhouette, "PAIR_ROWS", (rows, rows))
    monkeypatch.setattr(silhouette, "TILE", (5, 11))
    x, good, random = planted(120)
    x[40:80], good[40:80] = x[40], good[40]                    # a third of all rows are one point
    for r in silhouette.silhouettes(frame(spark, x, good, random), [3, 4]).collect():
        label = (good, random)[r["labelling"]]
        assert r["silhouette"] == pytest.approx(by_pairs(x, label)[label == r["label"]].mean(), abs=1e-9)
