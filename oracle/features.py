"""Checks for transactions, dimension, panel, quarters, features and quality."""
from .ctes import GROUPS, build

SHARES = tuple(f"share_{g}" for g in GROUPS)
# columns that pass through sums of fractions, so the two engines may differ in the last bit
NOISY = ("spend_volatility", "avg_qoq_spend_change", "avg_yoy_spend_change")

SQL = {
    "clean_transactions": build("tx_card", "SELECT * FROM tx_card"),
    "customer_dim": build("dim_card", "SELECT * FROM dim_card"),
    "customer_month": build("panel_account", "SELECT * FROM panel_account"),
    "customer_quarter": build("quarter_account", "SELECT * EXCLUDE (no_prev) FROM quarter_account"),
    "customer_features": build("feat_card", f"""
SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in NOISY)}) FROM feat_card"""),
    "quality_report": build(("feat_card", "tx_card", "dim_card"), f"""
SELECT count(*) - count(DISTINCT customer_id) AS duplicate_customers,
       count(CASE WHEN abs({' + '.join(SHARES)} - 1) >= 1e-9 THEN 1 END) AS share_sum_violations,
       count(CASE WHEN monthly_spend IS NULL OR monthly_txns IS NULL OR avg_ticket IS NULL OR online_share IS NULL
                    OR weekend_share IS NULL OR late_night_share IS NULL OR spend_volatility IS NULL
                    OR {' OR '.join(f'{s} IS NULL' for s in SHARES)} THEN 1 END) AS cluster_feature_nulls,
       count(CASE WHEN generation NOT IN ('Silent', 'Boomers', 'Gen X', 'Millennials', 'Gen Z') THEN 1 END)
         AS unknown_generations,
       (SELECT count(*) FROM tx_card WHERE category_group = 'unmapped') AS unmapped_transactions,
       (SELECT count(*) FROM dim_card WHERE NOT attributes_consistent) AS inconsistent_customers
FROM feat_card"""),
}
