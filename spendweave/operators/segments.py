"""Segment numbering, naming and profiles for any customer labels, fitted or given."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import columns as C
from .quantiles import exact_quantiles, quantile_name

MEAN_COLUMNS = ("monthly_spend", "monthly_txns", "avg_ticket", "median_ticket", "online_share", "weekend_share",
                "late_night_share", "spend_volatility", *config.SHARE_COLUMNS)
INDEX_COLUMNS = ("monthly_spend", "monthly_txns", "avg_ticket", *config.SHARE_COLUMNS, "online_share",
                 "weekend_share", "late_night_share")


def order_by_spend(features: DataFrame, label: str, out: str = "segment_id") -> DataFrame:
    """Number labels 1..k from the highest to the lowest mean monthly spend."""
    means = features.groupBy(label).agg(F.avg("monthly_spend").alias("m"))
    ranks = means.select(label, F.row_number().over(Window.orderBy(F.desc("m"), label)).cast("long").alias(out))
    return features.join(F.broadcast(ranks), label)        # one row per label


def _segment_sums(features: DataFrame, key: str) -> DataFrame:
    return features.groupBy(key).agg(
        F.count("*").alias("n_customers"), C.money_sum("total_spend").alias("total"),
        F.count_if(F.col("gender") == "F").alias("women"),
        *[F.count_if(F.col("generation") == g).alias(f"n_{g}") for g in config.GENERATIONS],
        *[F.sum(c).alias(f"sum_{c}") for c in MEAN_COLUMNS])


def _with_means(sums: DataFrame) -> DataFrame:
    """Segment mean and portfolio mean (over customers) of every column; the input has one row per segment."""
    def whole():
        return Window.partitionBy()
    everyone = F.sum("n_customers").over(whole())
    return sums.withColumns({
        **{c: F.col(f"sum_{c}") / F.col("n_customers") for c in MEAN_COLUMNS},
        **{f"all_{c}": F.sum(f"sum_{c}").over(whole()) / everyone for c in MEAN_COLUMNS},
        "everyone": everyone, "all_total": C.money(F.sum("total").over(whole()))})


def rule_name():
    """Business name from the indices against the portfolio; the first rule that applies wins."""
    def index(c):
        return C.ratio(c, f"all_{c}")
    rules = config.SEGMENT_NAMES
    return (F.when(index("share_travel") >= rules["travel"][0], rules["travel"][1])
            .when(index("online_share") >= rules["online"][0], rules["online"][1])
            .when(index("monthly_spend") >= rules["spend_high"][0], rules["spend_high"][1])
            .when(index("monthly_spend") <= rules["spend_low"][0], rules["spend_low"][1])
            .otherwise(rules["other"][1]))


def _top(labelled_values, n: int):
    """Texts of the n largest values: sort (negated value, position, text) structs and join the texts."""
    entries = F.array(*[F.struct((-v).alias("v"), F.lit(i).alias("i"), text.alias("t"))
                        for i, (v, text) in enumerate(labelled_values)])
    return F.array_join(F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: e["t"]), " | ")


def profile(features: DataFrame, key: str = "segment_id", name: str | None = None) -> DataFrame:
    """One row per segment. ``name`` keeps given names; without it names follow the rules."""
    sums = _with_means(_segment_sums(features, key))
    ages = exact_quantiles(features, [key], "age_at_end", [0.5])
    labels = [(c, config.GROUP_LABELS[c.removeprefix("share_")]) for c in config.SHARE_COLUMNS]
    top = _top([(F.col(c), F.lit(text)) for c, text in labels], 3)
    over = _top([(C.ratio(c, f"all_{c}"), F.format_string("%s (%.1fx)", F.lit(text), C.ratio(c, f"all_{c}")))
                 for c, text in labels], 2)
    named = F.col(name) if name and name != key else (F.col(key) if name else rule_name())
    return sums.join(F.broadcast(ages), key).select(
        key, *([] if name == key else [named.alias("segment_name")]),
        "n_customers", (F.col("n_customers") / F.col("everyone")).alias("customer_share"),
        C.ratio("total", "all_total").alias("spend_share"),
        *[c for c in MEAN_COLUMNS if c not in config.SHARE_COLUMNS],
        F.col(quantile_name(0.5)).alias("median_age"),
        (F.col("women") / F.col("n_customers")).alias("pct_female"),
        *config.SHARE_COLUMNS, top.alias("top_categories"), over.alias("over_indexed"),
        *[(F.col(f"n_{g}") / F.col("n_customers")).alias(f"gen_{g}") for g in config.GENERATIONS])


def unique_names(profiles: DataFrame, key: str = "segment_id") -> DataFrame:
    """Give a repeated rule name the segment number as suffix."""
    repeats = F.count("*").over(Window.partitionBy("segment_name"))
    return profiles.withColumn("segment_name", F.when(repeats > 1, F.concat_ws(" ", "segment_name", key))
                               .otherwise(F.col("segment_name")))


def index_matrix(features: DataFrame, key: str = "segment_id") -> DataFrame:
    """Segment mean over portfolio mean, plain and as log2, one row per segment and metric."""
    means = _with_means(_segment_sums(features, key))
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), C.ratio(c, f"all_{c}").alias("index"),
                              F.log2(C.ratio(c, f"all_{c}")).alias("log2_index")) for c in INDEX_COLUMNS])
    return means.select(key, F.inline(rows))


def top_categories(features: DataFrame, key: str = "segment_id", n: int = 3) -> DataFrame:
    """The n category groups with the largest mean wallet share per segment, ranked."""
    means = features.groupBy(key).agg(*[F.avg(c).alias(c) for c in config.SHARE_COLUMNS])
    rows = F.array(*[F.struct(F.lit(config.GROUP_LABELS[g]).alias("category"), F.col(f"share_{g}").alias("share"),
                              F.lit(i).alias("pos")) for i, g in enumerate(config.CATEGORY_GROUPS)])
    long = means.select(key, F.inline(rows))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("share"), "pos")).cast("long")
    return long.withColumn("rank", rank).filter(F.col("rank") <= n).drop("pos")


def crosstab(features: DataFrame, key: str, other: str) -> DataFrame:
    """Counts and share within the segment for every pair that occurs."""
    counts = features.groupBy(key, other).agg(F.count("*").alias("customers"))
    return counts.withColumn("share", F.col("customers") / F.sum("customers").over(Window.partitionBy(key)))


def majority_share(features: DataFrame, key: str = "segment_id") -> DataFrame:
    """Share of the largest segment: the accuracy of always guessing it."""
    counts = features.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("majority_baseline_accuracy"))
