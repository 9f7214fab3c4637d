"""Group comparison: summaries, tests with effect sizes, and the age-band artifact check."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import columns as C
from . import stats
from .quantiles import exact_quantiles, quantile_name

METRICS = config.GENERATION_METRICS
LEAST_GAIN = 1e-12


def age_band_cuts(features: DataFrame) -> DataFrame:
    """Two birth-year cuts where late-night behaviour steps, as one row (first_cut, second_cut).

    A regression tree with three leaves on one ordered feature: take the cut that lowers the squared error most, then
    the best cut of either side. Sums per birth year are all it needs, so the windows run over calendar years.
    """
    years = features.groupBy("birth_year").agg(
        F.count("*").alias("n"), F.round(F.sum("late_night_share"), 9).alias("s"))

    def best_cut(df, *side):
        upto = Window.partitionBy(*side).orderBy("birth_year")
        whole = Window.partitionBy(*side)
        nl, sl = F.sum("n").over(upto), F.sum("s").over(upto)
        n, s = F.sum("n").over(whole), F.sum("s").over(whole)
        scan = (df.withColumn("next_year", F.lead("birth_year").over(upto))
                .withColumn("nl", nl).withColumn("sl", sl).withColumn("n_all", n).withColumn("s_all", s)
                .filter(F.col("next_year").isNotNull())
                .withColumn("gain", C.ratio(F.col("sl") * F.col("sl"), "nl")
                            + C.ratio((F.col("s_all") - F.col("sl")) * (F.col("s_all") - F.col("sl")),
                                      F.col("n_all") - F.col("nl"))
                            - C.ratio(F.col("s_all") * F.col("s_all"), "n_all"))
                .filter(F.col("gain") > LEAST_GAIN))
        first = F.struct((-F.col("gain")).alias("g"), F.col("birth_year").alias("y"))
        return scan.agg(F.min_by("birth_year", first).alias("last_left"),
                        F.min_by(F.floor((F.col("birth_year") + F.col("next_year")) / 2), first).alias("cut"))

    one = best_cut(years)
    sides = years.crossJoin(F.broadcast(one)).withColumn("left", F.col("birth_year") <= F.col("last_left"))
    two = best_cut(sides.filter(F.col("left").isNotNull()).select("birth_year", "n", "s", "left"), "left")
    both = one.select(F.col("cut").alias("a")).crossJoin(F.broadcast(two.select(F.col("cut").alias("b"))))
    return both.select(F.least("a", "b").alias("first_cut"),
                       F.when(F.col("b").isNotNull(), F.greatest("a", "b")).alias("second_cut"))


def cut_values(features: DataFrame) -> tuple[int | None, int | None]:
    """The two cuts as numbers: one row with two integers, so bands become plain comparisons in every later plan."""
    row = age_band_cuts(features).first()
    return row["first_cut"], row["second_cut"]


def with_buckets(features: DataFrame, cuts: tuple[int | None, int | None]) -> DataFrame:
    """Add age_band and txns_per_day_tier."""
    first, second = (F.lit(c).cast("long") for c in cuts)
    return (features.withColumn("age_band", C.age_band("birth_year", first, second))
            .withColumn("txns_per_day_tier", C.txns_per_day_tier()))


def bucket_table(features: DataFrame, cuts: tuple[int | None, int | None]) -> DataFrame:
    return with_buckets(features, cuts).select("customer_id", "age_band", "txns_per_day_tier")


def summary(features: DataFrame) -> DataFrame:
    """Customers, mean and exact median per generation and metric."""
    rows = stats.stack_metrics(features, METRICS, ["generation"])
    medians = exact_quantiles(rows, ["generation", "metric"], "value", [0.5])
    means = rows.groupBy("generation", "metric").agg(
        F.count("*").alias("n_customers"), F.avg("value").alias("mean"))
    return (means.join(F.broadcast(medians), ["generation", "metric"])
            .withColumnRenamed(quantile_name(0.5), "median"))


def summary_with_ci(features: DataFrame, n_boot: int = config.N_RESAMPLES) -> DataFrame:
    return with_intervals(summary(features), stats.median_ci(features, METRICS, "generation", "customer_id", n_boot))


def with_intervals(summary_table: DataFrame, intervals: DataFrame) -> DataFrame:
    """A row for each generation and metric on either side."""
    return summary_table.join(F.broadcast(intervals), ["generation", "metric"])


def _splits(features: DataFrame) -> dict[str, list[float]]:
    return stats.range_splits(features, METRICS, stats.RANK_ROWS)


def kruskal_by(features: DataFrame, group: str) -> DataFrame:
    return stats.kruskal(features, [], group, METRICS, _splits(features))


def _big_groups(banded: DataFrame) -> DataFrame:
    """Generations of a band with enough customers: one row per band and generation at most."""
    return (banded.groupBy("age_band", "generation").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= config.MIN_GROUP_SIZE).select("age_band", "generation", F.lit(True).alias("big")))


def rank_tests(banded: DataFrame) -> DataFrame:
    """Rank tests of every metric by generation, by age band and by generation within each band, in one pass.

    ``design`` names the comparison and ``stratum`` the band; slivers of a generation are left out within a band.
    """
    marked = banded.join(F.broadcast(_big_groups(banded)), ["age_band", "generation"], "left")
    designs = F.array(
        F.struct(F.lit("generation").alias("design"), F.lit("").alias("stratum"), F.col("generation").alias("grp")),
        F.struct(F.lit("age_band").alias("design"), F.lit("").alias("stratum"), F.col("age_band").alias("grp")),
        F.struct(F.lit("within").alias("design"), F.col("age_band").alias("stratum"),
                 F.when(F.col("big"), F.col("generation")).alias("grp")))
    spread = marked.select(*METRICS, F.inline(designs)).filter(F.col("grp").isNotNull())
    return stats.kruskal(spread, ["design", "stratum"], "grp", METRICS, _splits(marked))


def kruskal_within_band(banded: DataFrame) -> DataFrame:
    """Tests of generation inside each age band that has two generations of sufficient size."""
    kept = banded.join(F.broadcast(_big_groups(banded)), ["age_band", "generation"], "left_semi")
    tests = stats.kruskal(kept, ["age_band"], "generation", METRICS, _splits(kept))
    return tests.filter(F.col("statistic").isNotNull())


def associations(banded: DataFrame) -> DataFrame:
    """Chi-square of the widest category and of the frequency tier against generation and age band."""
    top = C.widest(config.SHARE_COLUMNS, config.CATEGORY_GROUPS)
    values = banded.select("generation", "age_band", top.alias("top"),
                           F.col("txns_per_day_tier").cast("string").alias("tier"))
    counted = values.groupBy("generation", "age_band", "top", "tier").agg(F.count("*").alias("c"))
    pairs = F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.lit(by).alias("compared_by"), F.col(by).alias("a"),
                 F.col(value).alias("b"))
        for metric, value in (("top_category_group", "top"), ("txns_per_day_tier", "tier"))
        for by in ("generation", "age_band")])
    return stats.chi_square(counted.select("c", F.inline(pairs)), ["metric", "compared_by"], "a", "b", "c")


def test_battery(banded: DataFrame) -> DataFrame:
    """All tests with effects by generation, by band and within band, Holm-adjusted together."""
    def where(condition, column):
        return F.max(F.when(condition, F.col(column)))

    main, band = F.col("design") == "generation", F.col("design") == "age_band"
    within = F.when(F.col("design") == "within", F.col("effect_size"))
    weight = F.when(within.isNotNull(), F.col("n"))
    ranks = rank_tests(banded).groupBy("metric").agg(
        F.lit("Kruskal-Wallis").alias("test"), where(main, "statistic").alias("statistic"),
        where(main, "p_value").alias("p_value"), where(main, "effect_size").alias("effect_size"),
        F.lit("epsilon squared").alias("effect_measure"), where(band, "effect_size").alias("effect_by_age_band"),
        (F.sum(within * weight) / F.sum(weight)).alias("effect_within_age_band"))
    main, band = F.col("compared_by") == "generation", F.col("compared_by") == "age_band"
    tables = associations(banded).groupBy("metric").agg(
        F.lit("Chi-square").alias("test"), where(main, "statistic").alias("statistic"),
        where(main, "p_value").alias("p_value"), where(main, "effect_size").alias("effect_size"),
        F.lit("Cramer's V").alias("effect_measure"), where(band, "effect_size").alias("effect_by_age_band"),
        F.lit(None).cast("double").alias("effect_within_age_band"))
    label = F.when(F.col("effect_measure") == "epsilon squared", C.effect_label("effect_size")).otherwise("")
    return stats.holm(ranks.unionByName(tables)).withColumn("effect_label", label)


def band_mix(banded: DataFrame) -> DataFrame:
    """Customers per generation and age band, side by side."""
    return (banded.groupBy("generation").pivot("age_band", list(config.AGE_BANDS)).count().na.fill(0))


def band_definitions(banded: DataFrame) -> DataFrame:
    """First and last birth year and size of each age band."""
    return banded.groupBy("age_band").agg(F.min("birth_year").alias("first_birth_year"), F.max("birth_year").alias("last_birth_year"),
                                          F.count("*").alias("customers"), F.avg("late_night_share").alias("late_night_share"))


def artifact_summary(tests: DataFrame, cuts: tuple[int | None, int | None]) -> DataFrame:
    """Do generation effects survive inside an age band? One row."""
    return tests.filter(F.col("test") == "Kruskal-Wallis").agg(
        F.median("effect_size").alias("median_effect_by_generation"),
        F.median("effect_by_age_band").alias("median_effect_by_age_band"),
        F.median("effect_within_age_band").alias("median_effect_within_age_band"),
        F.max("effect_within_age_band").alias("max_effect_within_age_band"),
        F.lit(cuts[0]).cast("long").alias("first_cut"), F.lit(cuts[1]).cast("long").alias("second_cut"))


def insight_inputs(summary_table: DataFrame, tests: DataFrame) -> DataFrame:
    """Median per generation, effect and p per metric: the numbers behind the written insights."""
    wide = summary_table.groupBy("metric").pivot("generation", list(config.GENERATIONS)).agg(F.first("median"))
    return wide.join(F.broadcast(tests.select("metric", "effect_size", "p_value")), "metric")
