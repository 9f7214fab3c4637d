"""Checks for the data profile."""
from .ctes import GROUPS, build

_MEASURES = {"Monthly spend ($)": "monthly_spend", "Transactions per month": "monthly_txns",
             "Average ticket ($)": "avg_ticket", "Recency (days)": "recency_days"}
_CLUSTER = ("monthly_spend", "monthly_txns", "avg_ticket", *(f"share_{g}" for g in GROUPS), "online_share",
            "weekend_share", "late_night_share", "spend_volatility")
_DESCRIBED = (*_CLUSTER, "recency_days", "avg_qoq_spend_change", "avg_yoy_spend_change")

SQL = {
    "profile_sources": build("raw_card", """
SELECT source_file AS file, count(*) AS rows, min(trans_ts) AS first_ts, max(trans_ts) AS last_ts,
       CAST(sum(is_fraud) AS BIGINT) AS fraud_rows FROM raw_card GROUP BY source_file"""),
    "profile_totals": build("raw_card", """
SELECT count(*) AS rows, count(DISTINCT trans_num) AS distinct_trans_num, CAST(sum(is_fraud) AS BIGINT) AS fraud_rows,
       count(DISTINCT cc_num) AS cards, min(trans_ts) AS first_ts, max(trans_ts) AS last_ts,
       count(*) - count(CASE WHEN amt IS NOT NULL AND category IS NOT NULL AND dob IS NOT NULL THEN 1 END)
         AS rows_with_nulls
FROM raw_card"""),
    "profile_flagged_only": build("raw_card", """
SELECT count(*) AS n FROM (SELECT cc_num FROM raw_card GROUP BY cc_num HAVING min(is_fraud) = 1)"""),
    "profile_consistency": build("dim_card", """
SELECT count(*) AS customers, count(CASE WHEN attributes_consistent THEN 1 END) AS consistent FROM dim_card"""),
    "profile_clean_totals": build("tx_card", """
SELECT count(*) AS rows, round(sum(amt), 4) AS spend, count(DISTINCT month) AS months FROM tx_card"""),
    "profile_categories": build("tx_card", """
SELECT category, category_group, channel, txns, spend, spend / (SELECT round(sum(amt), 4) FROM tx_card) AS spend_share,
       spend / txns AS avg_ticket, median_ticket
FROM (SELECT category, any_value(category_group) AS category_group, any_value(channel) AS channel, count(*) AS txns,
             round(sum(amt), 4) AS spend, round(median(amt), 6) AS median_ticket
      FROM tx_card GROUP BY category)"""),
    "profile_amount_quantiles": build("tx_card", """
SELECT round(quantile_cont(amt, 0.01), 6) AS p01, round(quantile_cont(amt, 0.25), 6) AS p25,
       round(median(amt), 6) AS p50, round(sum(amt), 4) / count(*) AS mean, round(quantile_cont(amt, 0.75), 6) AS p75,
       round(quantile_cont(amt, 0.95), 6) AS p95, round(quantile_cont(amt, 0.99), 6) AS p99, max(amt) AS max
FROM tx_card"""),
    "profile_feature_quantiles": build("feat_card", "\nUNION ALL\n".join(f"""
SELECT '{label}' AS measure, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
       round(median({c}), 6) AS p50, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.75), 6) AS p75,
       CAST(max({c}) AS DOUBLE) AS max FROM feat_card""".strip() for label, c in _MEASURES.items())),
    "profile_generations": build("feat_card", """
SELECT generation, count(*) AS customers, count(*) / (SELECT count(*) FROM feat_card) AS share,
       min(birth_year) AS first_birth_year, max(birth_year) AS last_birth_year,
       round(median(monthly_spend), 6) AS median_monthly_spend
FROM feat_card GROUP BY generation"""),
    "profile_months": build("panel_card", """
SELECT strftime(month, '%Y-%m') AS month, txns, spend, active_customers,
       spend / (SELECT round(sum(spend), 4) / count(DISTINCT month) FROM panel_card) AS index_vs_avg
FROM (SELECT month, CAST(sum(txns) AS BIGINT) AS txns, round(sum(spend), 4) AS spend,
             count(DISTINCT CASE WHEN txns > 0 THEN customer_id END) AS active_customers
      FROM panel_card GROUP BY month)"""),
    "profile_tiers": build("feat_card", """
SELECT CAST(round(n_txns / (active_months * CAST(30.44 AS DOUBLE)), 0) AS BIGINT) AS txns_per_day_tier,
       count(*) AS customers, min(n_txns) AS min_txns, max(n_txns) AS max_txns FROM feat_card GROUP BY 1"""),
    "profile_hour_blocks": build("tx_card", """
SELECT CASE WHEN hour(trans_ts) >= 12 THEN '12:00 to 23:59' ELSE '00:00 to 11:59' END AS block, count(*) AS txns,
       count(*) / CAST(12 AS DOUBLE) AS avg_txns_per_hour FROM tx_card GROUP BY 1"""),
    "profile_ticket_bands": build("tx_card", """
SELECT ticket, n AS txns, n / sum(n) OVER () AS txn_share, s / round(sum(s) OVER (), 4) AS spend_share
FROM (SELECT CASE WHEN amt < 100 THEN 'Under $100' WHEN amt < 500 THEN '$100 to $499' ELSE '$500 or more' END AS ticket,
             count(*) AS n, round(sum(amt), 4) AS s
      FROM tx_card WHERE category = 'travel' GROUP BY 1)"""),
    "feature_description": build("feat_card", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS measure, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max,
       round(median({c}), 6) AS median FROM feat_card""".strip() for c in _DESCRIBED)),
}
