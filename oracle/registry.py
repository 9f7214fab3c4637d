"""All checks by query name."""
from . import features, generations, holdout, profile, segmentation, segments, triggers

SQL = {}
for _module in (features, triggers, holdout, profile, generations, segments, segmentation):
    SQL.update(_module.SQL)

# column subsets and joins of results that have their own SQL
_GENERATIONS = ("Silent", "Boomers", "Gen X", "Millennials", "Gen Z")
_SUBSETS = {
    "report_targeting": ("targeting_scores", ("benefit_label", "rank", "segment_name", "n_customers", "engagement", "headroom", "value",
                                              "score", "category_share_of_wallet", "category_monthly_spend")),
    "report_size_vs_spend": ("segment_profile", ("segment_name", "n_customers", "customer_share", "spend_share")),
    "report_generation_mix": ("segment_profile", ("segment_name", *(f"gen_{g}" for g in _GENERATIONS))),
    "report_placebo": ("trigger_placebo", ("trigger_name", "actual_fires", "placebo_fires_mean", "placebo_fires_min", "placebo_fires_max",
                                           "actual_to_placebo_ratio")),
    "report_follow_up": ("trigger_follow_up", ("scope", "trigger_name", "trigger_period_index", "follow_up_index", "long_run_index",
                                               "share_of_drop_recovered_unaided")),
}
for _name, (_of, _columns) in _SUBSETS.items():
    SQL[_name] = "SELECT " + ", ".join(f'"{c}"' for c in _columns) + f" FROM ({SQL[_of]})"
SQL["generation_summary_ci"] = (f"SELECT * FROM ({SQL['generation_summary']}) JOIN ({SQL['generation_median_ci']}) "
                                "USING (generation, metric)")
SQL["report_generation_bars"] = ("SELECT generation, n_customers, metric, median, median_ci_low, median_ci_high "
                                 f"FROM ({SQL['generation_summary_ci']}) WHERE metric IN ('online_share', 'monthly_txns', 'median_ticket')")
