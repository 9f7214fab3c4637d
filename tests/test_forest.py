"""Forests grown from counts by cell."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spendweave.operators import forest


def gini_cut(code, label, least=forest.LEAST):
    """The best cut of one predictor, row by row."""
    def impurity(y):
        return len(y) - sum(np.sum(y == v) ** 2 for v in set(y)) / max(1, len(y))
    cuts = [c for c in sorted(set(code))[:-1] if min(np.sum(code <= c), np.sum(code > c)) >= least]
    return min(cuts, key=lambda c: impurity(label[code <= c]) + impurity(label[code > c]))


def test_a_tree_cuts_where_rows_say():
    rng = np.random.default_rng(5)
    code = rng.integers(0, 40, 600)
    label = np.where(rng.random(600) < 0.2, rng.integers(0, 3, 600), (code > 11) + (code > 30))
    bag = np.zeros((40, 3))
    np.add.at(bag, (code, label), 1)
    shares = forest.leaf_shares(np.arange(40)[:, None], bag, 1, rng)
    cut = gini_cut(code, label)
    for side in (code <= cut, code > cut):
        want = np.bincount(label[side], minlength=3) / side.sum()
        assert shares[np.unique(code[side])] == pytest.approx(np.tile(want, (len(set(code[side])), 1)))


def test_leaves_keep_their_least_size():
    rng = np.random.default_rng(6)
    codes = np.stack(np.meshgrid(range(20), range(20)), -1).reshape(-1, 2)
    bag = rng.poisson(0.7, (400, 4)).astype(float)
    shares = forest.leaf_shares(codes, bag, 30, rng)
    leaves, at = np.unique(shares.round(12), axis=0, return_inverse=True)
    filled = np.bincount(at.ravel(), bag.sum(axis=1))
    assert len(leaves) > 10 and filled.min() >= forest.LEAST
    for i in range(len(leaves)):
        assert bag[at.ravel() == i].sum(axis=0) / filled[i] == pytest.approx(leaves[i])


def test_one_birth_year_decides(spark):
    """A label that changes between two of eighty years is told without a mistake; 32 bins put several years together."""
    rows = spark.range(8000).select(F.col("id").alias("customer_id"), F.expr("cast(id div 80 % 5 as int)").alias("fold"), (1924 + F.col("id") * 37 % 80).alias("year"))
    for year in (1947, 1960, 1981):
        labelled = rows.withColumn("y", F.when(F.col("year") < year, 0.0).otherwise(1.0))
        inputs = labelled.select("customer_id", "fold", "y", array_to_vector(F.array(F.col("year").cast("double"), F.lit(1.0))).alias("v")).persist()
        found = forest.out_of_fold(inputs, 10, 30, 42)
        assert found.where("y = predicted").count() == found.select("customer_id").distinct().count() == 8000
        inputs.unpersist()
