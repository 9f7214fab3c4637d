"""Named subqueries and a helper that strings the needed ones together."""
from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, needs: tuple[str, ...], sql: str) -> None:
    CTES[name] = (needs, sql.strip())


def build(needs: tuple[str, ...] | str, body: str) -> str:
    """WITH list of everything ``needs`` depends on, in order, followed by the body."""
    ordered: list[str] = []

    def visit(name):
        if name in ordered:
            return
        for dep in CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for name in ((needs,) if isinstance(needs, str) else needs):
        visit(name)
    parts = ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in ordered)
    return f"WITH {parts}\n{body.strip()}"


GROUPS = ("travel", "dining_entertainment", "grocery", "gas_transport", "shopping", "health_personal",
          "home_kids_pets", "misc")
GROUP_MEMBERS = {
    "travel": "('travel')", "dining_entertainment": "('food_dining', 'entertainment')",
    "grocery": "('grocery_pos', 'grocery_net')", "gas_transport": "('gas_transport')",
    "shopping": "('shopping_pos', 'shopping_net')", "health_personal": "('health_fitness', 'personal_care')",
    "home_kids_pets": "('home', 'kids_pets')", "misc": "('misc_pos', 'misc_net')",
}

_CATEGORIES = ("['travel','food_dining','entertainment','grocery_pos','grocery_net','gas_transport','shopping_pos',"
               "'shopping_net','health_fitness','personal_care','home','kids_pets','misc_pos','misc_net']")


def _raw(key: str) -> str:
    return f"""
SELECT CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'part1' ELSE 'part2' END AS source_file,
       concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS trans_num,
       o_orderdate + to_hours(CAST((l_orderkey * 7 + l_linenumber * 5) % 24 AS INT)) AS trans_ts,
       {key} AS cc_num,
       {_CATEGORIES}[CAST(l_partkey % 14 AS INT) + 1] AS category,
       l_extendedprice / 100 AS amt,
       CASE WHEN ({key}) % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       [1000, 10000, 100000, 500000][CAST(({key}) % 4 AS INT) + 1] + ({key}) % 997 AS city_pop,
       DATE '1924-01-01' + CAST((({key}) * 7919) % 29900 AS INT) AS dob,
       CASE WHEN (l_orderkey * 31 + l_linenumber) % 200 = 0 THEN 1 ELSE 0 END AS is_fraud
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


define("raw_card", (), _raw("o_custkey"))
define("raw_account", (), _raw("o_custkey // 37"))
define("label_card", (), "SELECT c_custkey AS customer_id, c_mktsegment AS segment_name FROM customer")
define("label_account", (), """
SELECT c_custkey // 37 AS customer_id, arg_min(c_mktsegment, c_custkey) AS segment_name
FROM customer GROUP BY c_custkey // 37""")

for _grain in ("card", "account"):
    _tx = f"tx_{_grain}"
    define(_tx, (f"raw_{_grain}",), f"""
SELECT trans_num, cc_num AS customer_id, trans_ts, CAST(trans_ts AS DATE) AS trans_date,
       make_date(year(trans_ts), month(trans_ts), 1) AS month,
       make_date(year(trans_ts), 3 * quarter(trans_ts) - 2, 1) AS quarter,
       category,
       CASE {' '.join(f"WHEN category IN {m} THEN '{g}'" for g, m in GROUP_MEMBERS.items())}
            ELSE 'unmapped' END AS category_group,
       CASE right(category, 4) WHEN '_net' THEN 'online' WHEN '_pos' THEN 'in_store' ELSE 'untagged' END AS channel,
       amt,
       dayofweek(trans_ts) IN (0, 6) AS is_weekend,
       NOT (hour(trans_ts) BETWEEN 5 AND 21) AS is_late_night
FROM raw_{_grain} WHERE is_fraud = 0""")
    define(f"dim_{_grain}", (f"raw_{_grain}", _tx), f"""
SELECT customer_id, dob, birth_year,
       CASE WHEN birth_year <= 1945 THEN 'Silent' WHEN birth_year <= 1964 THEN 'Boomers'
            WHEN birth_year <= 1980 THEN 'Gen X' WHEN birth_year <= 1996 THEN 'Millennials' ELSE 'Gen Z' END
         AS generation,
       (SELECT max(year(trans_date)) FROM {_tx}) - birth_year AS age_at_end,
       gender, city_pop,
       CASE WHEN city_pop >= 250000 THEN '4 Large city (250k+)' WHEN city_pop >= 25000 THEN '3 Mid city (25k-250k)'
            WHEN city_pop >= 2500 THEN '2 Small town (2.5k-25k)' ELSE '1 Rural (<2.5k)' END AS city_size_band,
       distinct_values = 3 AS attributes_consistent
FROM (SELECT cc_num AS customer_id, min(dob) AS dob, CAST(year(min(dob)) AS BIGINT) AS birth_year,
             min(gender) AS gender, min(city_pop) AS city_pop,
             count(DISTINCT dob) + count(DISTINCT gender) + count(DISTINCT city_pop) AS distinct_values
      FROM raw_{_grain} WHERE is_fraud = 0 GROUP BY cc_num)""")
    # every customer against every calendar month of the data, cut to the customer's own span
    define(f"panel_{_grain}", (_tx,), f"""
SELECT customer_id, month, count(*) OVER (PARTITION BY customer_id ORDER BY month) AS month_idx,
       CAST(n AS BIGINT) AS txns, s AS spend, ts AS travel_spend, CAST(tn AS BIGINT) AS travel_txns,
       ds AS dining_spend, CAST(dn AS BIGINT) AS dining_txns
FROM (
  SELECT p.customer_id, c.month, count(t.trans_num) AS n, coalesce(round(sum(t.amt), 4), 0) AS s,
         coalesce(round(sum(CASE WHEN t.category = 'travel' THEN t.amt END), 4), 0) AS ts,
         coalesce(sum(CASE WHEN t.category = 'travel' THEN 1 END), 0) AS tn,
         coalesce(round(sum(CASE WHEN t.category = 'food_dining' THEN t.amt END), 4), 0) AS ds,
         coalesce(sum(CASE WHEN t.category = 'food_dining' THEN 1 END), 0) AS dn
  FROM (SELECT customer_id, min(month) AS a, max(month) AS b FROM {_tx} GROUP BY customer_id) p
  JOIN (SELECT DISTINCT month FROM {_tx}) c ON c.month >= p.a AND c.month <= p.b
  LEFT JOIN {_tx} t ON t.customer_id = p.customer_id AND t.month = c.month
  GROUP BY p.customer_id, c.month)""")
    define(f"quarter_{_grain}", (f"panel_{_grain}",), f"""
SELECT q.*,
       (q.spend - q.prev_q_spend) IS NULL AS no_prev,
       CASE WHEN prev_q_spend > 0 THEN spend / prev_q_spend - 1 END AS qoq_spend_change,
       CASE WHEN prev_y_spend > 0 THEN spend / prev_y_spend - 1 END AS yoy_spend_change,
       CASE WHEN prev_q_travel_spend > 0 THEN travel_spend / prev_q_travel_spend - 1 END AS qoq_travel_change
FROM (
  SELECT *, lag(spend) OVER w AS prev_q_spend, lag(spend, 4) OVER w AS prev_y_spend,
         lag(travel_spend) OVER w AS prev_q_travel_spend
  FROM (SELECT customer_id, make_date(year(month), 3 * quarter(month) - 2, 1) AS quarter,
               round(sum(spend), 4) AS spend, CAST(sum(txns) AS BIGINT) AS txns,
               round(sum(travel_spend), 4) AS travel_spend, round(sum(dining_spend), 4) AS dining_spend
        FROM panel_{_grain} GROUP BY ALL)
  WINDOW w AS (PARTITION BY customer_id ORDER BY quarter)) q""")
    _sums = ",\n         ".join(
        f"coalesce(round(sum(CASE WHEN category_group = '{g}' THEN amt END), 4), 0) AS sp_{g}" for g in GROUPS)
    define(f"feat_{_grain}", (_tx, f"dim_{_grain}", f"panel_{_grain}", f"quarter_{_grain}"), f"""
SELECT d.customer_id, d.generation, d.birth_year, d.age_at_end, d.gender, d.city_pop, d.city_size_band,
       CAST((SELECT max(trans_date) FROM {_tx}) - t.last_day AS BIGINT) AS recency_days,
       t.span AS active_months, t.n AS n_txns, t.total AS total_spend,
       t.n / t.span AS monthly_txns, t.total / t.span AS monthly_spend, t.total / t.n AS avg_ticket,
       t.med AS median_ticket,
       {', '.join(f'sp_{g} / t.total AS share_{g}' for g in GROUPS)},
       coalesce(sp_online / nullif(sp_tagged, 0), 0) AS online_share,
       t.weekend / t.n AS weekend_share, t.night / t.n AS late_night_share,
       coalesce(m.sd / nullif(t.total / m.months, 0), 0) AS spend_volatility,
       q.avg_qoq AS avg_qoq_spend_change, q.last_qoq AS last_qoq_spend_change, q.avg_yoy AS avg_yoy_spend_change,
       sp_travel / t.span AS monthly_travel_spend, sp_food / t.span AS monthly_dining_spend,
       t.n_food / t.span AS monthly_dining_txns, t.n_travel AS txns_travel, t.n_travel_100 AS txns_travel_100plus,
       m.dining_months / m.months AS dining_active_month_share,
       m.travel_months / m.months AS travel_active_month_share,
       t.travel_years / t.years AS travel_active_year_share
FROM dim_{_grain} d
JOIN (SELECT customer_id, count(*) AS n, round(sum(amt), 4) AS total, max(trans_date) AS last_day,
         median(amt) AS med,
         CAST(12 * (year(max(month)) - year(min(month))) + month(max(month)) - month(min(month)) + 1 AS BIGINT) AS span,
         {_sums},
         coalesce(round(sum(CASE WHEN channel = 'online' THEN amt END), 4), 0) AS sp_online,
         coalesce(round(sum(CASE WHEN channel <> 'untagged' THEN amt END), 4), 0) AS sp_tagged,
         coalesce(round(sum(CASE WHEN category = 'food_dining' THEN amt END), 4), 0) AS sp_food,
         count(CASE WHEN is_weekend THEN 1 END) AS weekend, count(CASE WHEN is_late_night THEN 1 END) AS night,
         count(CASE WHEN category = 'food_dining' THEN 1 END) AS n_food,
         count(CASE WHEN category = 'travel' THEN 1 END) AS n_travel,
         count(CASE WHEN category = 'travel' AND amt >= 100 THEN 1 END) AS n_travel_100,
         count(DISTINCT year(trans_date)) AS years,
         count(DISTINCT CASE WHEN category = 'travel' AND amt >= 100 THEN year(trans_date) END) AS travel_years
      FROM {_tx} GROUP BY customer_id) t USING (customer_id)
JOIN (SELECT customer_id, count(*) AS months, stddev_samp(spend) AS sd,
             count(CASE WHEN dining_txns > 0 THEN 1 END) AS dining_months,
             count(CASE WHEN travel_txns > 0 THEN 1 END) AS travel_months
      FROM panel_{_grain} GROUP BY customer_id) m USING (customer_id)
JOIN (SELECT customer_id, avg(qoq_spend_change) AS avg_qoq, avg(yoy_spend_change) AS avg_yoy,
             arg_max(qoq_spend_change, quarter) FILTER (WHERE qoq_spend_change IS NOT NULL) AS last_qoq
      FROM quarter_{_grain} GROUP BY customer_id) q USING (customer_id)""")
