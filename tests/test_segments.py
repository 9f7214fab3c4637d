"""Numbering, naming, profiles, targeting and the fitted models."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendweave import config
from spendweave.functions import columns as C
from spendweave.operators import quality, segmentation, segments, targeting


def test_segments_are_numbered_from_the_highest_spend(spark):
    df = spark.createDataFrame(pd.DataFrame({"monthly_spend": [10.0, 12, 500, 520, 90, 100],
                                             "label": [2, 2, 0, 0, 1, 1]}))
    rows = segments.order_by_spend(df, "label").orderBy("monthly_spend").collect()
    assert [r["segment_id"] for r in rows] == [3, 3, 2, 2, 1, 1]


def scored_customers(spark):
    rows = []
    for name, spend, dining in (("High value", 10_000.0, 200.0), ("Low value", 2_000.0, 40.0),
                                ("Saturated", 10_000.0, 3_000.0)):
        rows += [(name, spend, dining, 1.0, 10.0, 0.5)] * 10
    return spark.createDataFrame(rows, "segment_name string, monthly_spend double, monthly_dining_spend double, "
                                       "dining_active_month_share double, monthly_travel_spend double, "
                                       "travel_active_year_share double")


def test_scores_rank_value_with_room_first(spark):
    scores = targeting.score_segments(scored_customers(spark))
    dining = {r["segment_name"]: r for r in scores.filter("benefit = 'dining_credit'").collect()}
    assert dining["High value"]["rank"] == 1 and dining["High value"]["value"] == 1
    assert dining["Saturated"]["score"] == 0
    assert dining["Low value"]["value"] == pytest.approx(0.2)
    assert max(r["score_index"] for r in dining.values()) == 100
    row = dining["Low value"]
    assert row["score"] == pytest.approx(row["engagement"] * row["headroom"] * row["value"])


def test_best_of_the_others(spark):
    scores = targeting.score_segments(scored_customers(spark))
    rows = {r["segment_name"]: r["best_other"] for r in targeting.best_of_the_others(scores).collect()}
    assert rows == pytest.approx({"Saturated": 0.02, "High value": 0.3, "Low value": 0.3})


def synthetic_features(spark, n=120):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"customer_id": np.arange(n), "kind": np.arange(n) % 3})
    shares = rng.dirichlet(np.ones(8) * 5, n)
    shares[pdf.kind == 0, 0] += 2
    shares /= shares.sum(axis=1, keepdims=True)
    for i, c in enumerate(config.SHARE_COLUMNS):
        pdf[c] = shares[:, i]
    pdf["monthly_spend"] = np.array([5000.0, 1000.0, 9000.0])[pdf.kind] + rng.normal(0, 10, n)
    pdf["total_spend"] = pdf.monthly_spend * 24
    pdf["monthly_txns"] = np.array([50.0, 10.0, 100.0])[pdf.kind] + rng.normal(0, 1, n)
    for c in ("avg_ticket", "median_ticket", "online_share", "weekend_share", "late_night_share", "spend_volatility"):
        pdf[c] = rng.uniform(0.4, 0.6, n)
    pdf["gender"] = np.where(pdf.customer_id % 2 == 0, "F", "M")
    pdf["generation"] = np.array(["Silent", "Gen X", "Gen Z"])[pdf.kind]
    pdf["age_at_end"] = np.array([75, 45, 22])[pdf.kind]
    pdf["birth_year"] = 2020 - pdf.age_at_end
    pdf["city_pop"] = 1000 + pdf.customer_id
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def features(spark):
    return synthetic_features(spark).cache()


def test_profile_names_and_mix(features):
    numbered = segments.order_by_spend(features, "kind")
    rows = {r["segment_id"]: r for r in segments.profile(numbered).collect()}
    assert rows[1]["segment_name"] == "Premium Household Shoppers"
    assert rows[2]["segment_name"] == "Big-Ticket Travelers" and rows[2]["top_categories"].startswith("Travel | ")
    assert rows[3]["segment_name"] == "Light Home and Dining Spenders"
    assert [rows[i]["n_customers"] for i in (1, 2, 3)] == [40, 40, 40]
    assert rows[2]["gen_Silent"] == 1 and rows[2]["median_age"] == 75 and rows[1]["pct_female"] == 0.5
    assert sum(r["spend_share"] for r in rows.values()) == pytest.approx(1)


def test_repeated_names_are_reported_and_can_be_told_apart(spark):
    twice = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "segment_id long, segment_name string")
    with pytest.raises(quality.QualityError):
        quality.require_unique_names(twice)
    fixed = segments.unique_names(twice)
    quality.require_unique_names(fixed)
    assert {r["segment_name"] for r in fixed.collect()} == {"A 1", "A 2", "B"}


def test_fitted_segments(features):
    matrix = segmentation.prepare_matrix(features)
    model = segmentation.fit_kmeans(matrix, 3, n_init=3)
    worse = segmentation.fit_kmeans(matrix, 2, n_init=3)
    assert worse.cost > model.cost and model.sizes.sum() == 120
    segmented = segmentation.segment_features(features, matrix, model)
    from spendweave.operators import stats
    assert stats.adjusted_rand(segmented, "segment_id", "kind").first()["ari"] == pytest.approx(1)
    steady = segmentation.stability(segmentation.bootstrap_ari(matrix, model, 3, n_boot=2, n_init=1)).first()
    assert steady["bootstrap_ari_mean"] > 0.9
    points = model.transform(matrix).toPandas()
    x, label = np.vstack([v.toArray() for v in points.x]), points.cluster.to_numpy()
    distance = ((x[:, None] - model.centres[None]) ** 2).sum(-1)
    assert (distance.argmin(1) == label).all() and distance.min(1).sum() == pytest.approx(model.cost)
    for c in range(3):
        assert x[label == c].mean(0) == pytest.approx(model.centres[c], abs=1e-3)
    coordinates, explained = segmentation.project(matrix)
    assert coordinates.count() == 120 and 0 < explained[1] <= explained[0] <= 1


def test_weighted_fit_equals_a_fit_of_repeated_rows(spark):
    """A resample's weights act as copies, and all fits of a batch give what they give alone."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"customer_id": np.arange(90), "a": np.r_[rng.normal(0, 1, 45), rng.normal(9, 1, 45)], "b": rng.normal(0, 1, 90)})
    from pyspark.ml.feature import VectorAssembler
    matrix = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(spark.createDataFrame(pdf)).select("customer_id", "x")
    points = segmentation.fit_points(matrix, 3)
    fits = [segmentation.Fit(2, 0), *[segmentation.Fit(2, s, r) for r in range(3) for s in range(2)]]
    together = segmentation.fit_all(points, fits)
    weights = {r["customer_id"]: r["w"] for r in points.collect()}
    assert abs(np.mean([sum(w) for w in weights.values()]) - 3) < 0.7
    for found in together:
        alone = segmentation.fit_all(points, [found.fit])[0]
        assert alone.centres == pytest.approx(found.centres) and alone.cost == pytest.approx(found.cost)
        w = np.array([1 if found.fit.resample is None else weights[c][found.fit.resample] for c in pdf.customer_id])
        x = pdf[["a", "b"]].to_numpy().repeat(w, axis=0)
        near = ((x[:, None] - found.centres[None]) ** 2).sum(-1)
        assert near.min(1).sum() == pytest.approx(found.cost)
        for c in range(2):
            assert x[near.argmin(1) == c].mean(0) == pytest.approx(found.centres[c], abs=1e-3)


def test_more_centres_than_points(spark):
    from pyspark.ml.linalg import Vectors
    matrix = spark.createDataFrame([(1, Vectors.dense(1.0)), (2, Vectors.dense(1.0))], ["customer_id", "x"])
    found = segmentation.fit_kmeans(matrix, 3, n_init=2)
    assert found.cost == 0 and found.centres.shape == (3, 1)


def test_scaling_matches_numpy(features):
    got = segmentation.scaled_columns(features).toPandas().sort_values("customer_id")
    raw = np.log1p(features.toPandas().sort_values("customer_id")["monthly_spend"].to_numpy())
    assert got["monthly_spend"].to_numpy() == pytest.approx((raw - raw.mean()) / raw.std())


def test_folds_are_stratified(features):
    folds = segmentation.stratified_folds(features, "kind").groupBy("kind", "fold").count().collect()
    assert sorted({(r["kind"], r["fold"]): r["count"] for r in folds}.values()) == [8] * 15


def test_forest_sees_what_demographics_tell(features):
    labelled = segments.order_by_spend(features, "kind").withColumn("txns_per_day_tier", F.lit(1))
    row = segmentation.artifact_check(labelled, "segment_id", trees=5, depth=4).first()
    assert row["majority_baseline_accuracy"] == pytest.approx(1 / 3)
    assert row["demographics_only_accuracy"] > 0.95


def test_everybody_is_predicted_once_out_of_fold(features):
    labelled = segments.order_by_spend(features, "kind")
    inputs = segmentation.forest_inputs(labelled)
    rows = segmentation.out_of_fold(inputs, trees=5, depth=4).collect()
    assert sorted(r["customer_id"] for r in rows) == list(range(120))
    assert {(r["customer_id"], r["label"]) for r in rows} == {(r["customer_id"], r["segment_id"]) for r in labelled.collect()}
    by_fold = [np.mean([r["label"] == r["predicted"] for r in rows if r["fold"] == f]) for f in range(5)]
    assert segmentation.forest_accuracy(labelled, trees=5, depth=4) == pytest.approx(np.mean(by_fold))


def mixture_points(spark, n=900, d=3):
    rng = np.random.default_rng(8)
    kind = rng.choice(3, n, p=[0.5, 0.3, 0.2])
    spread = np.array([np.eye(d), np.diag([0.2, 2.0, 1.0]), [[1, 0.8, 0], [0.8, 1, 0], [0, 0, 0.1]]])
    x = np.array([rng.multivariate_normal([8.0 * k, -4.0 * k, 0], spread[k]) for k in kind])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "customer_id long, x array<double>")
    return frame.select("customer_id", F.xxhash64("customer_id").alias("h"), "x", F.array().cast("array<int>").alias("w")).cache(), x, kind, spread


@pytest.mark.parametrize("direct", [20_000, 0])       # partial results straight to the driver, and combined in an exchange
def test_mixtures_find_planted_components(spark, monkeypatch, direct):
    monkeypatch.setattr(segmentation, "DIRECT_ROWS", direct)
    points, x, kind, spread = mixture_points(spark)
    found = segmentation.fit_all_mixtures(points, [2, 3], n_init=2)
    best = segmentation.likeliest(found)
    assert best[3].bic(len(x)) < best[2].bic(len(x))
    for m in found:
        assert len(m.trace) > 1 and min(np.diff(m.trace)) > -segmentation.MIXTURE_ENDED
        assert np.linalg.eigvalsh(m.covariances).min() >= segmentation.FLOOR * (1 - 1e-6)
        # the last value of the trace, by the textbook formula
        density = sum(p * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(v), x - mean)) / np.sqrt(np.linalg.det(2 * np.pi * v))
                      for p, mean, v in zip(m.shares, m.means, m.covariances))
        assert m.trace[-1] == pytest.approx(np.log(density).mean())
    order = np.argsort(best[3].means[:, 0])
    assert best[3].shares[order] == pytest.approx([np.mean(kind == k) for k in range(3)], abs=0.01)
    for k, c in enumerate(order):
        own = x[kind == k]
        assert best[3].means[c] == pytest.approx(own.mean(0), abs=0.05)
        assert best[3].covariances[c] == pytest.approx(np.cov(own.T, bias=True) + segmentation.FLOOR * np.eye(3), abs=0.1)
    sizes = {r["component"]: r["customers"] for r in segmentation.component_sizes(points, best[3]).collect()}
    assert [sizes[c] for c in order] == [int((kind == k).sum()) for k in range(3)]


def test_mixture_of_repeated_points_stays_at_the_floor(spark):
    rows = [(i, [float(i % 2), 1.0]) for i in range(40)]
    points = spark.createDataFrame(rows, "customer_id long, x array<double>").select(
        "customer_id", F.xxhash64("customer_id").alias("h"), "x", F.array().cast("array<int>").alias("w"))
    for m in segmentation.fit_all_mixtures(points, [2, 3], n_init=1):
        assert np.isfinite(m.trace).all() and m.shares.sum() == pytest.approx(1)
        assert np.linalg.eigvalsh(m.covariances).min() >= segmentation.FLOOR * (1 - 1e-6)


def test_labels_that_agree(spark):
    points, x, kind, _ = mixture_points(spark)
    mixture = segmentation.likeliest(segmentation.fit_all_mixtures(points, [3], n_init=1))[3]
    centres = segmentation.Centres(segmentation.Fit(3, 0), mixture.means[::-1])
    rows = segmentation.agreement(points, [centres, mixture], [(7, 0, 1), (8, 1, 1)]).collect()
    assert {r["rep"]: r["ari"] for r in rows} == pytest.approx({7: 1.0, 8: 1.0}, abs=0.02)


def test_small_tables_come_in_few_tasks_and_blocks_hold_every_point(spark):
    """Forty partitions of a small table are one task of a pass; with many centres there are more. Nothing is lost on the way."""
    points = spark.range(0, 3000, 1, 40).select(
        F.col("id").alias("h"), F.array(F.col("id") * 1.0, F.col("id") % 7 * 1.0).alias("x"), F.array((F.col("id") % 3).cast("int")).alias("w"))
    assert segmentation.packed(points, 50).getNumPartitions() == 1
    many = segmentation.packed(points, 100_000)
    assert 8 <= many.getNumPartitions() <= 12
    h, x, w = (np.concatenate(v) for v in zip(*many.collect()))
    assert sorted(h.tolist()) == list(range(3000)) and (x[:, 0] == h).all() and (x[:, 1] == h % 7).all() and (w[:, 0] == h % 3).all()


def test_cluster_sums_against_plain_sums():
    rng = np.random.default_rng(2)
    x, weight = rng.normal(size=(500, 3)), rng.integers(0, 4, 500)
    centres = [rng.normal(size=(4, 3)), np.array([[0.0, 0, 0], [0, 0, 0], [1, 1, 1]])]          # repeated centres: the first counts
    total = np.zeros((7, 5))
    segmentation._cluster_sums(x, [weight.astype(float), None], centres, total)
    row = 0
    for at, drawn in zip(centres, (weight, np.ones(500))):
        squared = ((x[:, None, :] - at[None]) ** 2).sum(axis=2)
        for c in range(len(at)):
            mine = (squared.argmin(axis=1) == c) * drawn
            plain = [mine.sum(), (mine * squared[:, c]).sum(), *(mine @ x)]
            assert np.allclose(total[row], plain)
            row += 1


def flat_matrix(spark, n=3000, d=3):
    """Customers without clusters, on which K-means moves for long."""
    from pyspark.ml.linalg import Vectors
    x = np.random.default_rng(11).uniform(-1, 1, (n, d))
    return spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x.tolist())], ["customer_id", "x"]).repartition(3)


@pytest.mark.parametrize("most", [(300_000, 600), (300_000, 65_536)])      # few undecided customers, and whole resamples in a task
def test_rooms_save_passes_and_change_no_fit(spark, monkeypatch, most):
    points, fits = segmentation.fit_points(flat_matrix(spark), 4), [segmentation.Fit(4, s, r) for r in (None, 0, 1, 2, 3) for s in range(2)]
    passes = []
    for name in ("_one_step", "_steps_within"):
        plain = getattr(segmentation, name)
        monkeypatch.setattr(segmentation, name, lambda *a, f=plain: (passes.append(1), f(*a)))
    with monkeypatch.context() as none:
        none.setattr(segmentation, "_room", lambda *a: 0.0)
        by_passes = segmentation.fit_all(points, fits)
    full = len(passes)
    monkeypatch.setattr(segmentation, "UNDECIDED", most)
    monkeypatch.setattr(segmentation, "SENT", 1)
    by_rooms = segmentation.fit_all(points, fits)
    assert full == max(f.steps for f in by_passes), (full, len(passes))
    assert len(passes) - full < full / 2, (full, len(passes))
    for one, other in zip(by_passes, by_rooms):
        assert one.settled and other.settled and one.steps == other.steps and one.sizes == pytest.approx(other.sizes)
        assert one.centres == pytest.approx(other.centres, abs=1e-9) and one.cost == pytest.approx(other.cost)


def test_undecided_points_are_left_out_of_the_sums():
    rng = np.random.default_rng(4)
    x, weight = rng.normal(size=(700, 3)), rng.integers(0, 3, 700).astype(float)
    weights, centres = [weight, None, weight], [rng.normal(size=(k, 3)) for k in (4, 2, 5)]
    whole, _, leads = segmentation._sums(x, weights, centres, sample=True)
    sure, undecided, _ = segmentation._sums(x, weights, centres, [0.2, 0.1, np.inf])
    first = np.cumsum([0, 4, 2, 5])
    assert (leads[:, 0] == [(weight > 0).sum(), 700, (weight > 0).sum()]).all() and (leads[:, 1] == segmentation.SAMPLED).all()
    for i, (given, at, room, some) in enumerate(zip(weights, centres, (0.2, 0.1, np.inf), undecided)):
        distance = np.sort(np.sqrt(((x[:, None] - at) ** 2).sum(-1)), axis=1)
        drawn = np.ones(700) if given is None else given
        assert some.tolist() == np.flatnonzero((distance[:, 1] - distance[:, 0] <= 2 * room) & (drawn > 0)).tolist()
        rest = segmentation._sums(x[some], [drawn[some]], [at])[0]
        assert sure[first[i]:first[i + 1]] + rest == pytest.approx(whole[first[i]:first[i + 1]])


def test_weights_are_poisson_draws_from_the_hash(spark):
    from hashlib import md5
    from math import exp, factorial
    matrix = flat_matrix(spark, 40)
    bounds = np.cumsum([exp(-1) / factorial(i) for i in range(14)])
    for r in segmentation.fit_points(matrix, 5).collect():
        u = [(int(md5(f"42|{rep}|{r['customer_id']}".encode()).hexdigest()[:8], 16) + 0.5) / 2 ** 32 for rep in range(5)]
        assert r["w"] == np.searchsorted(bounds, u, side="right").tolist()
    assert all(r["w"] == [] for r in segmentation.fit_points(matrix).collect())
