"""Quantiles, ranks, tests and resampling against brute force."""
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendweave.functions import columns as C
from spendweave.operators import generations as G
from spendweave.operators import quantiles as Q
from spendweave.operators import stats

SPARK_EXAMPLES = settings(max_examples=6, deadline=None)


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def brute_h(values, groups):
    ranks = pd.Series(values).rank().to_numpy()
    n = len(values)
    s = sum(ranks[groups == g].sum() ** 2 / (groups == g).sum() for g in np.unique(groups))
    _, t = np.unique(values, return_counts=True)
    return (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - (t ** 3 - t).sum() / (n ** 3 - n))


# --- quantiles -------------------------------------------------------------

@pytest.mark.parametrize("leaf", [1, 20, 10_000])
def test_exact_quantiles(spark, monkeypatch, leaf):
    """Few cells and small leaves force many rounds; one key holds most rows, and most values are outliers' neighbours."""
    monkeypatch.setattr(Q, "LEAF_ROWS", leaf)
    monkeypatch.setattr(Q, "CELLS", 16 if leaf == 20 else 4_096)
    rng = np.random.default_rng(leaf)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "a", "b", None], 4000, p=[0.8, 0.17, 0.02, 0.01]), "v": rng.lognormal(3, 2, 4000)})
    pdf.loc[pdf.index % 7 == 0, "v"] = 5.0                       # heavy ties
    pdf.loc[[3, 5], "v"] = [1e12, -1e9]
    probs = [0.0, 0.01, 0.25, 0.5, 0.5001, 0.9, 1.0]
    got = {r["k"]: r for r in Q.exact_quantiles(spark.createDataFrame(pdf, "k string, v double"), ["k"], "v", probs).collect()}
    for k, part in pdf.groupby("k", dropna=False):
        key = None if k is None or k != k else k
        assert [got[key][Q.quantile_name(p)] for p in probs] == pytest.approx(list(np.quantile(part.v, probs)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert Q.exact_quantiles(empty, ["k"], "v", [0.5]).count() == 0
    assert list(Q.exact_quantiles(empty, [], "v", [0.5]).first()) == [None]


@SPARK_EXAMPLES
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=12))
def test_median_of_tiny_groups(spark, values):
    got = Q.exact_quantiles(frame(spark, v=[float(v) for v in values]), [], "v", [0.25, 0.5]).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0.25, 0.5])))


def test_hot_customers_take_the_other_path_to_the_same_median(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"customer_id": rng.choice([1, 2, 3, 4], 3000, p=[0.4, 0.3, 0.2, 0.1]),
                        "amt": np.round(rng.gamma(2, 50, 3000), 2)})
    df = spark.createDataFrame(pdf)
    hot = Q.find_hot_keys(df.withColumn("txns", F.lit(1)), threshold=700)
    assert sorted(r[0] for r in hot.collect()) == [1, 2]
    assert Q.find_hot_keys(df.withColumn("txns", F.lit(1)), threshold=5000) is None
    got = {r[0]: r[1] for r in Q.keyed_median(df, "customer_id", "amt", "m", hot).collect()}
    assert got == pytest.approx(pdf.groupby("customer_id").amt.median().to_dict())


# --- rank and contingency tests --------------------------------------------

def test_kruskal_separated_and_identical_groups(spark):
    n = 30
    df = frame(spark, apart=[float(i) for i in range(n)], same=[float(i // 3) for i in range(n)],
               g=["abc"[i // 10] for i in range(n)], h=["abc"[i % 3] for i in range(n)])
    apart = stats.kruskal(stats.stack_metrics(df, ["apart"], ["g"]), ["metric"], "g").first()
    same = stats.kruskal(stats.stack_metrics(df, ["same"], ["h"]), ["metric"], "h").first()
    assert apart["effect_size"] > 0.85 and apart["p_value"] < 0.001
    assert same["effect_size"] < 0.02


def test_kruskal_does_not_depend_on_the_splits(spark):
    rng = np.random.default_rng(5)
    values, groups = np.round(rng.gamma(1, 3, 500), 1), rng.choice(["x", "y", "z"], 500, p=[0.7, 0.2, 0.1])
    df = frame(spark, v=values, g=groups)
    splits = stats.range_splits(df, ["v"], rows_per_bucket=40)
    assert len(splits["v"]) > 5
    for s in (None, splits):
        row = stats.kruskal(stats.stack_metrics(df, ["v"], ["g"], s), ["metric"], "g").first()
        assert row["statistic"] == pytest.approx(brute_h(values, groups))


def test_ranks_meet_as_packed_counts(spark, monkeypatch):
    """Equal values shared by most rows, NULL lowest and NaN highest, over several ranges and packs; no window goes over single values."""
    monkeypatch.setattr(stats, "PACK_ROWS", 300)
    rng = np.random.default_rng(6)
    values, groups = np.where(rng.random(4000) < 0.6, 2.0, np.round(rng.gamma(1, 3, 4000), 2)), rng.choice(["x", "y", None], 4000, p=[0.7, 0.2, 0.1])
    rows = [(None if i % 50 == 0 else float("nan") if i % 50 == 1 else -0.0 if i % 50 == 2 else float(v), g) for i, (v, g) in enumerate(zip(values, groups))]
    df = spark.createDataFrame(rows, "v double, g string").repartition(3)
    splits = stats.range_splits(df, ["v"], rows_per_bucket=400)
    assert len(splits["v"]) > 3
    stacked = stats.stack_metrics(df, ["v"], ["g"], splits)
    found = stats.kruskal(stacked, ["metric"], "g")
    plain = [-1e9 if v is None else 1e9 if v != v else v for v, _ in rows]
    assert found.first()["n"] == 4000 and found.first()["statistic"] == pytest.approx(brute_h(np.array(plain), np.array([g or "" for _, g in rows])))
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert windows and not any("value" in line for line in windows)
    assert stats.kruskal(df, [], "g", ["v"], splits).collect() == found.collect()      # without stacking
    packed = stats.packed_counts(stacked, ["metric"], "g").collect()
    assert sum(sum(r["c"]) for r in packed) == 4000
    assert max(len(r["value"]) for r in packed) <= 300 + 4000 / 3 and len(packed) < 300


def test_kruskal_with_one_group_has_no_statistic(spark):
    df = frame(spark, v=[1.0, 2.0], g=["a", "a"])
    row = stats.kruskal(stats.stack_metrics(df, ["v"], ["g"]), ["metric"], "g").first()
    assert row["statistic"] is None and row["p_value"] is None


def test_chi_square_tail(spark):
    pairs = [(7.94272, 4, 0.0937), (3.841459, 1, 0.05), (0.0, 3, 1.0), (248.94, 4, 0.0)]
    df = spark.createDataFrame([(x, k) for x, k, _ in pairs], "x double, k int")
    got = [r[0] for r in df.select(C.chi2_survival("x", "k")).collect()]
    assert got == pytest.approx([p for *_, p in pairs], abs=5e-5)


def test_cramers_v_bounds(spark):
    def v(table):
        rows = [(a, b, n) for (a, b), n in table.items() if n]
        df = spark.createDataFrame(rows, "a string, b string, n long")
        return stats.chi_square(df, [], "a", "b", "n").first()
    assert v({("p", "q"): 50, ("r", "s"): 50})["effect_size"] == pytest.approx(1, abs=0.02)
    assert v({(a, b): 25 for a in "pr" for b in "qs"})["effect_size"] == pytest.approx(0)
    flat = v({("p", "q"): 3, ("r", "q"): 5})
    assert flat["p_value"] == 1 and flat["effect_size"] is None


def test_holm_by_hand(spark):
    df = spark.createDataFrame([("a", 0.04), ("b", 0.01), ("c", 0.02)], "t string, p_value double")
    got = {r["t"]: r["p_holm"] for r in stats.holm(df).collect()}
    assert got == pytest.approx({"a": 0.04, "b": 0.03, "c": 0.04})


@SPARK_EXAMPLES
@given(st.lists(st.floats(0, 1), min_size=1, max_size=8))
def test_holm_is_monotone_and_at_most_one(spark, ps):
    rows = stats.holm(frame(spark, p_value=ps)).orderBy("p_value").collect()
    adjusted = [r["p_holm"] for r in rows]
    assert adjusted == sorted(adjusted) and max(adjusted) <= 1
    assert all(r["p_holm"] >= r["p_value"] - 1e-12 for r in rows)


def test_effect_labels(spark):
    df = spark.createDataFrame([(0.005,), (0.03,), (0.1,), (0.3,), (float("nan"),), (None,)], "e double")
    assert [r[0] for r in df.select(C.effect_label("e")).collect()] == [
        "negligible", "small", "medium", "large", "n/a", "n/a"]


@SPARK_EXAMPLES
@given(st.lists(st.integers(0, 3), min_size=2, max_size=20))
def test_ari_of_a_relabelling_is_one(spark, labels):
    df = frame(spark, a=labels, b=[(l * 7 + 3) % 11 for l in labels])
    assert stats.adjusted_rand(df, "a", "b").first()["ari"] == pytest.approx(1)


def test_ari_by_hand(spark):
    df = frame(spark, a=[0, 0, 1, 1], b=[0, 0, 1, 2])
    assert stats.adjusted_rand(df, "a", "b").first()["ari"] == pytest.approx(0.5714285714)


# --- age bands and resampling ----------------------------------------------

def test_age_band_cuts_find_the_steps(spark):
    years = [y for y in range(1940, 2001) for _ in range(3)]
    level = [0.4 if y <= 1960 else 0.25 if y <= 1985 else 0.1 for y in years]
    df = spark.createDataFrame([(i, y, v) for i, (y, v) in enumerate(zip(years, level))],
                               "customer_id long, birth_year long, late_night_share double")
    assert G.cut_values(df) == (1960, 1985)
    one_year = df.filter("birth_year = 1950")
    assert one_year.count() == 3 and G.age_band_cuts(one_year).first()["first_cut"] is None


def scrambled(x):
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = (x ^ x >> shift) * factor % 2 ** 32
    return x ^ x >> 16


def plain_draws(seed, rep, part, draws, rows):
    key = scrambled((scrambled((seed * 0x9E3779B1 + rep) % 2 ** 32) + (part + 1) * 0x85EBCA77) % 2 ** 32)
    return [scrambled((key + j * 0x9E3779B9) % 2 ** 32) * rows >> 32 for j in range(draws)]


def test_counts_of_a_range_are_packed_and_come_in_blocks():
    """A range hands over a byte for each replicate and place around the middle, one block of replicates after the other."""
    rng, n, range_rows, n_boot = np.random.default_rng(3), 40_000, 10_000, 130
    places = np.stack([rng.permutation(n)[:range_rows] for _ in range(2)], axis=1)
    blocks = list(stats._range_middles(1, n, places, places.astype(float), n_boot, 42, range_rows))
    assert [[(m, first) for m, first, *_ in rows] for rows in blocks] == [[(m, first)] for first in range(0, n_boot, 64) for m in range(2)]
    start, stop = stats._window(n)
    inside = ((places >= start) & (places < stop)).sum(axis=0)
    assert sum(len(rows[0][5]) for rows in blocks) == n_boot * inside.sum()
    below = np.frombuffer(blocks[0][0][4], "<i8")
    drawn = stats.range_draws(42, 0, 1, int(stats.divided_draws(42, 0, n, range_rows)[1]), range_rows)
    assert below[0] == drawn[places[:, 0] < start].sum()


@pytest.mark.parametrize("range_rows", [1 << 16, 50])
def test_bootstrap_medians_against_plain_resampling(spark, range_rows):
    """The same draws one by one, for one range and for several; other partitions and rows in another order make no difference."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"customer_id": np.arange(160), "generation": rng.choice(["x", "y"], 160, p=[0.9, 0.1]),
                        "m": np.round(rng.gamma(2, 30, 160), 1), "k": rng.integers(0, 5, 160)})
    n_boot, want = 40, {}
    for name, part in pdf.groupby("generation"):
        part, n = part.sort_values("customer_id"), len(part)
        drawn = []
        for rep in range(n_boot):
            counts = stats.divided_draws(42, rep, n, range_rows) if n > range_rows else [n]
            assert sum(counts) == n
            drawn.append([r * range_rows + i for r, c in enumerate(counts) for i in plain_draws(42, rep, r, int(c), min(range_rows, n - r * range_rows))])
        for metric in ("m", "k"):
            medians = np.median(part[metric].to_numpy(float)[np.array(drawn)], axis=1)
            want[name, metric] = tuple(np.quantile(medians, [0.025, 0.975]))
    for df in (spark.createDataFrame(pdf), spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(7)):
        got = {(r["generation"], r["metric"]): (r["median_ci_low"], r["median_ci_high"])
               for r in stats.median_ci(df, ["m", "k"], "generation", "customer_id", n_boot=n_boot, range_rows=range_rows).collect()}
        assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_draws_look_random():
    """Counts of draws have the mean and variance of a multinomial, divided between ranges or made within one."""
    within = np.array([stats.range_draws(1, rep, 2, 400, 50) for rep in range(3000)])
    between = np.array([stats.divided_draws(1, rep, 400, 8) for rep in range(3000)])
    assert within.sum(axis=1).tolist() == between.sum(axis=1).tolist() == [400] * 3000
    for counts in (within, between):
        assert abs(counts.mean(axis=0) - 8).max() < 0.25 and abs(counts.var(axis=0) - 8 * 0.98).max() < 1.1
        assert abs(np.corrcoef(counts.T) - np.eye(50) + 0.02 * (1 - np.eye(50))).max() < 0.09


def test_a_median_outside_the_counted_places_is_an_error(monkeypatch):
    monkeypatch.setattr(stats, "MIDDLE", 0.0)
    with pytest.raises(ArithmeticError):
        list(stats._range_middles(0, 50, np.arange(50)[:, None], np.ones((50, 1)), 30, 42, 1 << 16))


def test_a_value_of_a_third_of_all_rows_is_split(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["p", "q"], 6000), "id": np.arange(6000), "v": np.where(rng.random(6000) < 0.4, 0.0, np.round(rng.gamma(2, 3, 6000), 2))})
    df = spark.createDataFrame(pdf)
    sizes = [r["count"] for r in stats.numbering_pieces(df, "v", 500).groupBy("_b", "_part").count().collect()]
    assert max(sizes) < 1100 and pdf.v.eq(0).sum() > 2000
    got = stats.numbered(df, ["g"], "v", "pos", 500).toPandas()
    for _, part in got.groupby("g"):
        ordered = part.sort_values("pos")
        assert list(ordered.pos) == list(range(len(part))) and ordered.v.is_monotonic_increasing


def test_places_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.choice(["p", "q"], 300), "v": rng.integers(0, 40, 300)})
    got = stats.numbered(spark.createDataFrame(pdf), ["g"], "v", "pos").toPandas()
    for _, part in got.groupby("g"):
        ordered = part.sort_values("pos")
        assert list(ordered.pos) == list(range(len(part))) and ordered.v.is_monotonic_increasing
