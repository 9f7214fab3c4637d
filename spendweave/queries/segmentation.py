"""Fitted segments at card grain, with full numbers of starts, resamples and trees."""
from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config
from ..operators import generations, segmentation, segments, silhouette
from ..plans.workbench import bench_for
from ..sources import adapter
from .features import rounded
from .segments import round_doubles


def _features(spark, sf):
    return bench_for(spark, sf, "card").customer_features


def _matrix(spark, sf):
    return bench_for(spark, sf, "card").matrix


def _model(spark, sf):
    return bench_for(spark, sf, "card").kmeans


def _segmented(spark, sf):
    return segmentation.segment_features(_features(spark, sf), _matrix(spark, sf), _model(spark, sf))


def _labelled(spark, sf):
    """Given labels (market segment) with bands and tiers."""
    return bench_for(spark, sf, "card").banded.join(adapter.market_segments(spark, sf, "card"), "customer_id")


def cluster_matrix(spark, sf):
    return rounded(segmentation.scaled_columns(_features(spark, sf)), *config.CLUSTER_COLUMNS)


def stratified_folds(spark, sf):
    folds = segmentation.stratified_folds(_labelled(spark, sf), "segment_name")
    return folds.select("customer_id", "segment_name", F.col("fold").cast("long").alias("fold"))


def artifact_associations(spark, sf):
    return rounded(segmentation.attribute_associations(_labelled(spark, sf), "segment_name"), "statistic", "p_value",
                   "effect_size")


def majority_baseline(spark, sf):
    return segments.majority_share(_labelled(spark, sf), "segment_name")


def classifier_inputs(spark, sf):
    out = segmentation.predictor_columns(_labelled(spark, sf))
    return rounded(out.select("customer_id", "birth_year", F.col("is_female").cast("long").alias("is_female"),
                              "log_city_pop", "txns_per_day_tier"), "log_city_pop")


def kmeans_segments(spark, sf):
    return _segmented(spark, sf).select("customer_id", "segment_id")


def kmeans_profile(spark, sf):
    return round_doubles(segments.unique_names(segments.profile(_segmented(spark, sf))))


def kmeans_check(spark, sf):
    """What every K-means result has to fulfil, one row per cluster: each customer is nearest to its own centre, a centre is the
    mean of its members, sizes add up to all customers."""
    model = _model(spark, sf)
    labelled = model.transform(_matrix(spark, sf)).select("cluster", vector_to_array("x").alias("x"))
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(model.centres)]
    centres = F.broadcast(spark.createDataFrame(rows, "centre int, at array<double>"))       # a row for each segment
    distance = F.sqrt(F.aggregate(F.zip_with("x", "at", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    near = labelled.join(centres, F.col("cluster") == F.col("centre"))
    columns = [F.avg(F.get("x", F.lit(i))) - F.first(F.get("at", F.lit(i))) for i in range(len(config.CLUSTER_COLUMNS))]
    off = F.aggregate(F.array(*columns), F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v)))
    per_cluster = near.groupBy("cluster").agg(F.count("*").alias("customers"), off.alias("off"), F.max(distance).alias("radius"))
    everyone = F.sum("customers").over(Window.partitionBy())
    return per_cluster.select(F.col("cluster").cast("long").alias("cluster"), (F.col("off") < 1e-3).alias("centre_is_mean"),
                              (F.col("customers") > 0).alias("has_members"), everyone.alias("all_customers"))


def segment_assignments(spark, sf):
    segmented = _segmented(spark, sf)
    coordinates, _ = segmentation.project(_matrix(spark, sf))
    profiles = segments.unique_names(segments.profile(segmented))
    return segmentation.assignments(segmented, profiles, coordinates)


def bootstrap_stability(spark, sf):
    return segmentation.stability(segmentation.bootstrap_ari(_matrix(spark, sf), _model(spark, sf), config.CHOSEN_K))


def k_selection(spark, sf):
    return bench_for(spark, sf, "card").k_table


def k_selection_check(spark, sf):
    """What every k table has to fulfil, one row per k: the drop is that from the row of k - 1, more segments cost less, shares and
    indices are in their ranges, the silhouette is inside the range that the error leaves."""
    table, customers = k_selection(spark, sf), _matrix(spark, sf).count()
    before = table.select((F.col("k") + 1).alias("k"), F.col("inertia").alias("before"))
    drop = (F.col("before") - F.col("inertia")) / F.col("before")
    first = F.col("before").isNull()
    return table.join(F.broadcast(before), "k", "left").select(        # a row per k
        F.col("k").cast("long").alias("k"),
        F.when(first, F.col("inertia_drop_pct").isNull()).otherwise(F.abs(F.col("inertia_drop_pct") - drop) < 1e-9).alias("drop_is_right"),
        (first | (F.col("inertia") < F.col("before"))).alias("costs_less"),
        F.col("smallest_segment").between(1, F.lit(customers) / F.col("k")).alias("smallest_fits"),
        (F.col("bootstrap_ari_mean").between(-1, 1) & F.col("bootstrap_ari_p05").between(-1, 1) & F.col("gmm_vs_kmeans_ari").between(-1, 1)
         & F.col("silhouette_squared").between(-1, 1)).alias("indices_in_range"),
        ((F.col("silhouette_error") >= 0) & F.col("silhouette").between(-1 - F.col("silhouette_error"), 1 + F.col("silhouette_error")))
        .alias("silhouette_in_range"), F.lit(customers).cast("long").alias("all_customers"))


def segment_silhouette(spark, sf):
    """Plain-distance silhouette of the given labels."""
    labelled = segmentation.fit_points(_matrix(spark, sf)).select("customer_id", "x").join(adapter.market_segments(spark, sf, "card"), "customer_id")
    names = sorted(r[0] for r in labelled.select("segment_name").distinct().collect())
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("segment_name")) - 1
    points = labelled.select("x", F.array(number.cast("int")).alias("labels")).persist()
    found = silhouette.silhouettes(points, [len(names)])
    points.unpersist()
    return found.select(F.get(F.array(*[F.lit(n) for n in names]), F.col("label")).alias("segment_name"), "customers",
                        F.round("silhouette", 6).alias("silhouette"))


def _mixtures(spark, sf):
    points = segmentation.fit_points(_matrix(spark, sf))
    return points, segmentation.fit_all_mixtures(points, [config.CHOSEN_K])


def gmm_bic(spark, sf):
    points, found = _mixtures(spark, sf)
    model = segmentation.likeliest(found)[config.CHOSEN_K]
    return segmentation.component_sizes(points, model).withColumn("gmm_bic", F.lit(model.bic(points.count())))


def mixture_check(spark, sf):
    """What every mixture has to fulfil, one row per start: no pass loses more of the mean log-likelihood than a fit may still gain at its
    end, no variance in any direction is below the floor, shares add up, everybody belongs to a component."""
    points, found = _mixtures(spark, sf)
    rows = []
    for m in found:
        least = float(np.linalg.eigvalsh(m.covariances).min())
        rows.append((m.start, [float(v) for v in m.trace], least, float(m.shares.sum()),
                     segmentation.component_sizes(points, m).agg(F.sum("customers")).first()[0]))
    fits = spark.createDataFrame(rows, "start long, trace array<double>, least double, shares double, all_customers long")
    steps = F.zip_with(F.slice("trace", 2, F.size("trace")), F.slice("trace", 1, F.size("trace") - 1), lambda after, before: after - before)
    return fits.select("start", F.forall(steps, lambda gain: gain >= -segmentation.MIXTURE_ENDED).alias("never_falls"),
                       (F.element_at("trace", -1) >= F.element_at("trace", 1)).alias("gains"),
                       (F.col("least") >= segmentation.FLOOR * (1 - 1e-6)).alias("above_floor"),
                       (F.abs(F.col("shares") - 1) < 1e-9).alias("shares_add_up"), "all_customers")


def pca_2d(spark, sf):
    coordinates, explained = segmentation.project(_matrix(spark, sf))
    with_shares = coordinates.withColumn("explained_1", F.lit(explained[0])).withColumn("explained_2", F.lit(explained[1]))
    return rounded(with_shares, "pca_1", "pca_2", "explained_1", "explained_2")


def artifact_classifier(spark, sf):
    banded = generations.with_buckets(_segmented(spark, sf), bench_for(spark, sf, "card").cuts)
    return segmentation.artifact_check(banded, "segment_id")


CHECK_TREES = 50


def forest_check(spark, sf):
    """Forests on a label that demographics decide (gender), a row per fold: everybody is predicted once, and rightly, by a forest that
    hasn't seen the fold."""
    number = F.when(F.col("gender") == "F", 1).otherwise(2)
    inputs = segmentation.forest_inputs(bench_for(spark, sf, "card").banded.withColumn("gender_id", number), "gender_id")
    found = segmentation.out_of_fold(inputs, CHECK_TREES)
    return found.groupBy(F.col("fold").cast("long").alias("fold")).agg(
        F.count("*").alias("customers"), F.count_distinct("customer_id").alias("different"), F.count_if(F.col("label") == 1).alias("women"),
        F.count_if(F.col("predicted") == F.col("label")).alias("hits"))


QUERIES = {f.__name__: f for f in (
    cluster_matrix, stratified_folds, artifact_associations, majority_baseline, classifier_inputs, kmeans_segments,
    kmeans_profile, kmeans_check, segment_assignments, bootstrap_stability, k_selection,
    k_selection_check, segment_silhouette, gmm_bic, mixture_check, pca_2d, artifact_classifier,
    forest_check)}
