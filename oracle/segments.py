"""Checks for segment profiles, scores, plays and report tables."""
from . import generations as g
from . import triggers as t
from .ctes import GROUPS, build, define

LABELS = dict(zip(GROUPS, ("Travel", "Dining and entertainment", "Grocery", "Gas and transport", "Shopping",
                           "Health and personal care", "Home, kids and pets", "Misc")))
MEANS = ("monthly_spend", "monthly_txns", "avg_ticket", "median_ticket", "online_share", "weekend_share",
         "late_night_share", "spend_volatility", *g.SHARES)
INDEXED = ("monthly_spend", "monthly_txns", "avg_ticket", *g.SHARES, "online_share", "weekend_share",
           "late_night_share")
GENS = ("Silent", "Boomers", "Gen X", "Millennials", "Gen Z")

for grain in ("card", "account"):
    define(f"lab_{grain}", (f"feat_{grain}", f"label_{grain}"), f"""
SELECT * FROM feat_{grain} JOIN label_{grain} USING (customer_id)""")
    define(f"seg_{grain}", (f"lab_{grain}",), f"""
SELECT segment_name AS label, count(*) AS n, round(sum(total_spend), 4) AS total, median(age_at_end) AS age,
       count(CASE WHEN gender = 'F' THEN 1 END) AS women,
       {', '.join(f'avg({c}) AS {c}' for c in MEANS)},
       {', '.join(f"count(CASE WHEN generation = '{x}' THEN 1 END) AS " + chr(34) + f'n_{x}' + chr(34) for x in GENS)}
FROM lab_{grain} GROUP BY segment_name""")
    define(f"all_{grain}", (f"lab_{grain}",), f"""
SELECT count(*) AS n, round(sum(total_spend), 4) AS total, {', '.join(f'avg({c}) AS {c}' for c in MEANS)}
FROM lab_{grain}""")
    define(f"score_{grain}", (f"lab_{grain}",), f"""
SELECT benefit, benefit_label, segment_name, n_customers, engagement, headroom, value,
       engagement * headroom * value AS score, category_share_of_wallet, category_monthly_spend,
       headroom_benchmark_share
FROM (SELECT benefit, benefit_label, segment_name, count(*) AS n_customers, avg(e) AS engagement,
             avg(CASE WHEN s >= b THEN 0 ELSE 1 - s / b END) AS headroom,
             avg(monthly_spend) / (SELECT max(m) FROM (SELECT avg(monthly_spend) AS m FROM lab_{grain}
                                                       GROUP BY segment_name)) AS value,
             avg(s) AS category_share_of_wallet, avg(c) AS category_monthly_spend, any_value(b) AS headroom_benchmark_share
      FROM (SELECT *, quantile_cont(s, 0.9) OVER (PARTITION BY benefit) AS b FROM (
              SELECT 'dining_credit' AS benefit, 'Monthly dining credit' AS benefit_label, segment_name, monthly_spend,
                     dining_active_month_share AS e, monthly_dining_spend AS c,
                     monthly_dining_spend / monthly_spend AS s FROM lab_{grain}
              UNION ALL
              SELECT 'travel_credit', 'Annual travel credit', segment_name, monthly_spend, travel_active_year_share,
                     monthly_travel_spend, monthly_travel_spend / monthly_spend FROM lab_{grain}))
      GROUP BY benefit, benefit_label, segment_name)""")
    define(f"ranked_{grain}", (f"score_{grain}",), f"""
SELECT *, row_number() OVER (PARTITION BY benefit ORDER BY score DESC, segment_name) AS rank,
       score / max(score) OVER (PARTITION BY benefit) * 100 AS score_index FROM score_{grain}""")

define("seg_ids", ("seg_card",), """
SELECT *, row_number() OVER (ORDER BY monthly_spend DESC, label) AS segment_id FROM seg_card""")
_long = " UNION ALL ".join(f"SELECT label, '{LABELS[x]}' AS category, share_{x} AS share, {i} AS pos FROM seg_card"
                           for i, x in enumerate(GROUPS))
define("shares_long", ("seg_card",), _long)
_over = " UNION ALL ".join(
    f"SELECT label, '{LABELS[x]}' AS category, s.share_{x} / a.share_{x} AS i, {k} AS pos FROM seg_card s, all_card a"
    for k, x in enumerate(GROUPS))
define("over_long", ("seg_card", "all_card"), _over)


def r6(*columns, prefix=""):
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in columns)


_SCORE_DOUBLES = ("engagement", "headroom", "value", "score", "category_share_of_wallet", "category_monthly_spend",
                  "headroom_benchmark_share")


def _others(grain):
    return f"""
SELECT segment_name, round(category_share_of_wallet, 6) AS category_share_of_wallet,
       round((SELECT max(category_share_of_wallet) FROM score_{grain} o
              WHERE o.benefit = 'dining_credit' AND o.segment_name <> s.segment_name), 6) AS best_other
FROM score_{grain} s WHERE benefit = 'dining_credit'"""


def _fired(trigger, what):
    inner = "count(DISTINCT customer_id)" if what == "customers" else "coalesce(round(sum(spend_at_stake), 4), 0)"
    return (f"(SELECT {inner} FROM ev_base JOIN label_account l USING (customer_id) "
            f"WHERE trigger_name = '{trigger}' AND l.segment_name = s.label) AS {trigger}_{what}")


def _best(benefit, what):
    return f"(SELECT {what} FROM ranked_account r WHERE r.segment_name = s.label AND r.benefit = '{benefit}')"


_summary = t.SQL["trigger_summary"]
_holdout = t.SQL["trigger_holdout"]
_monthly_a, _monthly_u = t.SQL["backtest_monthly"], t.SQL["backtest_monthly_unadjusted"]

SQL = {
    "segment_numbers": build(("seg_ids", "label_card", "feat_card"), """
SELECT customer_id, segment_name, segment_id FROM label_card JOIN feat_card USING (customer_id)
JOIN seg_ids ON label = segment_name"""),
    "segment_profile": build(("seg_ids", "all_card", "shares_long", "over_long"), f"""
SELECT s.segment_id,
       CASE WHEN s.share_travel / a.share_travel >= 2 THEN 'Big-Ticket Travelers'
            WHEN s.online_share / a.online_share >= 1.15 THEN 'Digital Shoppers'
            WHEN s.monthly_spend / a.monthly_spend >= 1.3 THEN 'Premium Household Shoppers'
            WHEN s.monthly_spend / a.monthly_spend <= 0.75 THEN 'Light Home and Dining Spenders'
            ELSE 'Mainstream Everyday Spenders' END AS segment_name,
       s.n AS n_customers, round(s.n / a.n, 6) AS customer_share, round(s.total / a.total, 6) AS spend_share,
       {r6(*MEANS, prefix='s.')}, round(s.age, 6) AS median_age, round(s.women / s.n, 6) AS pct_female,
       (SELECT string_agg(category, ' | ' ORDER BY share DESC, pos) FROM (
          SELECT *, row_number() OVER (ORDER BY share DESC, pos) AS k FROM shares_long l WHERE l.label = s.label)
        WHERE k <= 3) AS top_categories,
       (SELECT string_agg(printf('%s (%.1fx)', category, i), ' | ' ORDER BY i DESC, pos) FROM (
          SELECT *, row_number() OVER (ORDER BY i DESC, pos) AS k FROM over_long l WHERE l.label = s.label)
        WHERE k <= 2) AS over_indexed,
       {', '.join(f'round(s."n_{x}" / s.n, 6) AS "gen_{x}"' for x in GENS)}
FROM seg_ids s CROSS JOIN all_card a"""),
    "segment_index": build(("seg_card", "all_card"), "\nUNION ALL\n".join(f"""
SELECT label AS segment_name, '{c}' AS metric, round(s.{c} / a.{c}, 6) AS index,
       round(log2(s.{c} / a.{c}), 6) AS log2_index FROM seg_card s, all_card a""".strip() for c in INDEXED)),
    "top_categories": build("shares_long", """
SELECT label AS segment_name, category, round(share, 6) AS share, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY share DESC, pos) AS rank FROM shares_long) WHERE rank <= 3"""),
    "ari": build(("banded", "label_card"), """
SELECT labeling, round((c - a * b / p) / ((a + b) / 2 - a * b / p), 6) AS ari, n
FROM (SELECT labeling, n, CAST(n AS DOUBLE) * (n - 1) / 2 AS p,
        (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) AS k FROM x y WHERE y.labeling = z.labeling GROUP BY a, b)) AS c,
        (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) AS k FROM x y WHERE y.labeling = z.labeling GROUP BY a)) AS a,
        (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) AS k FROM x y WHERE y.labeling = z.labeling GROUP BY b)) AS b
      FROM (SELECT labeling, count(*) AS n FROM x GROUP BY labeling) z)""").replace(
        "\nSELECT labeling, round((c", """, x AS (
SELECT 'segment_name' AS labeling, segment_name AS a, generation AS b FROM banded JOIN label_card USING (customer_id)
UNION ALL SELECT 'age_band', age_band, generation FROM banded JOIN label_card USING (customer_id)
UNION ALL SELECT 'generation', generation, generation FROM banded JOIN label_card USING (customer_id))
SELECT labeling, round((c""", 1),
    "targeting_scores": build("ranked_card", f"""
SELECT benefit, benefit_label, segment_name, n_customers, {r6(*_SCORE_DOUBLES)}, rank, round(score_index, 6) AS score_index
FROM ranked_card"""),
    "targeting_top": build("ranked_card", """
SELECT benefit, benefit_label, segment_name, round(score, 6) AS score FROM ranked_card WHERE rank = 1"""),
    "best_of_the_others": build("score_card", _others("card")),
    "segment_plays": build(("seg_account", "all_account", "ranked_account", "ev_base", "label_account"), f"""
SELECT s.label AS segment_name, s.n AS n_customers, round(s.n / a.n, 6) AS customer_share,
       {r6('monthly_spend', 'monthly_txns', 'share_travel', 'online_share', prefix='s.')},
       {_best('dining_credit', 'rank')} AS dining_rank, round({_best('dining_credit', 'score')}, 6) AS dining_score,
       {_best('travel_credit', 'rank')} AS travel_rank, round({_best('travel_credit', 'score')}, 6) AS travel_score,
       o.category_share_of_wallet AS dining_share, o.best_other AS dining_share_elsewhere,
       {', '.join(_fired(x, 'customers') for x in ('travel_drop', 'first_travel', 'dining_cooling'))},
       {', '.join(_fired(x, 'stake') for x in ('travel_drop', 'first_travel', 'dining_cooling'))}
FROM seg_account s CROSS JOIN all_account a JOIN ({_others('account')}) o ON o.segment_name = s.label"""),
    "trigger_plays": f"""
SELECT s.trigger_name, CASE s.trigger_name WHEN 'travel_drop' THEN 'Travel drop' WHEN 'first_travel' THEN 'First travel'
                       ELSE 'Dining cooling' END AS trigger,
       s.fires, s.customers, s.pct_customers_ever_firing, s.spend_at_stake,
       CASE WHEN s.trigger_name <> 'first_travel' THEN CAST(0.5 AS DOUBLE) END AS drop_share,
       CASE s.trigger_name WHEN 'travel_drop' THEN CAST(200 AS DOUBLE) WHEN 'dining_cooling' THEN CAST(2 AS DOUBLE) END
         AS min_base,
       CASE s.trigger_name WHEN 'first_travel' THEN CAST(3 AS BIGINT) END AS min_history,
       h.fires_per_year, h.holdout, h.min_detectable_lift_pct, h.fires_needed_for_10pct_lift
FROM ({_summary}) s LEFT JOIN ({_holdout}) h ON h.trigger_name = s.trigger_name""",
    "report_wallet": build("gen_summary", f"""
SELECT generation, {', '.join(f"max(CASE WHEN metric = '{c}' THEN median END) AS {c}" for c in g.SHARES)}
FROM gen_summary GROUP BY generation"""),
    "report_birth_year": build("feat_card", """
SELECT birth_year, count(*) AS customers, round(avg(late_night_share), 6) AS late_night_share
FROM feat_card GROUP BY birth_year"""),
    "report_band_levels": build(("banded", "label_card"), """
SELECT age_band, min(birth_year) AS first_birth_year, max(birth_year) AS last_birth_year,
       round(avg(late_night_share), 6) AS late_night_share
FROM banded WHERE customer_id IN (SELECT customer_id FROM label_card) GROUP BY age_band"""),
    "report_seasonality": f"""
SELECT a.month, a.customers_firing AS portfolio_adjusted, u.customers_firing AS unadjusted,
       row_number() OVER (ORDER BY u.customers_firing DESC, a.month) = 1 AS is_peak
FROM ({_monthly_a}) a JOIN ({_monthly_u}) u ON u.month = a.month AND u.trigger_name = a.trigger_name
WHERE a.trigger_name = 'dining_cooling'""",
    "report_live_months": f"""
SELECT trigger_name, median(customers_firing) AS median_customers_firing FROM ({_monthly_a})
WHERE customers_firing > 0 GROUP BY trigger_name""",
    "report_category_group": build("tx_card", """
SELECT category_group, count(*) AS txns, round(sum(amt), 0) AS spend,
       round(100 * round(sum(amt), 4) / (SELECT round(sum(amt), 4) FROM tx_card), 1) AS pct_of_spend,
       round(round(sum(amt), 4) / count(*), 2) AS avg_ticket, round(median(amt), 2) AS median_ticket
FROM tx_card GROUP BY category_group"""),
    "report_overview": build(("raw_card", "tx_card"), """
SELECT count(*) AS raw_rows, CAST(sum(is_fraud) AS BIGINT) AS fraud_rows, count(DISTINCT cc_num) AS cards,
       min(trans_ts) AS first_ts, max(trans_ts) AS last_ts, (SELECT count(*) FROM tx_card) AS clean_rows,
       (SELECT count(DISTINCT customer_id) FROM tx_card) AS clean_customers,
       (SELECT round(sum(amt), 4) FROM tx_card) AS clean_spend FROM raw_card"""),
    "report_frequency_tiers": build("feat_account", """
SELECT CAST(round_even(n_txns / (active_months * CAST(30.44 AS DOUBLE)), 0) AS BIGINT) AS txns_per_day_tier,
       count(*) AS customers, min(n_txns) AS min_txns, max(n_txns) AS max_txns FROM feat_account GROUP BY 1"""),
    "report_customer_trace": build("quarter_card", """
SELECT quarter, round(spend, 0) AS spend, round(prev_q_spend, 0) AS prev_q_spend,
       round(qoq_spend_change, 3) AS qoq_change, round(yoy_spend_change, 3) AS yoy_change
FROM quarter_card WHERE customer_id = (SELECT min(customer_id) FROM quarter_card)"""),
    "report_crosstab": build(("banded", "label_card"), """
SELECT segment_name, age_band, count(*) AS customers,
       count(*) / sum(count(*)) OVER (PARTITION BY segment_name) AS share
FROM banded JOIN label_card USING (customer_id) GROUP BY segment_name, age_band"""),
    "report_crosstab_gender": build("lab_card", """
SELECT segment_name, gender, count(*) AS customers,
       count(*) / sum(count(*)) OVER (PARTITION BY segment_name) AS share
FROM lab_card GROUP BY segment_name, gender"""),
    "report_headlines": build("feat_card", f"""
SELECT count(*) AS customers, CAST(sum(n_txns) AS BIGINT) AS transactions, min(recency_days) AS min_recency,
       max(recency_days) AS max_recency, max(active_months) AS max_active_months,
       {', '.join(f"count(*) FILTER (WHERE generation = '{x}') AS " + chr(34) + x + chr(34) for x in GENS)}
FROM feat_card"""),
    "report_placebo_ratio": f"""
SELECT round(avg(actual_to_placebo_ratio), 6) AS mean_placebo_ratio FROM ({t.SQL['trigger_placebo']})""",
    "report_effects": build("battery", """
SELECT metric, test, effect_measure, round(effect_size, 6) AS effect_size,
       round(effect_within_age_band, 6) AS effect_within_age_band, round(p_holm, 6) AS p_holm FROM battery"""),
}
