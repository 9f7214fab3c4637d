"""Checks for the triggers and their backtest.

Written apart from the engine: windows reach back by fixed rows, lags are self joins on the month position, and the
cooldown is an anti join against earlier states.
"""
from .ctes import build, define

P = "panel_account"

define("port", (P,), f"""
SELECT month, round(sum(travel_spend), 4) AS travel, round(sum(dining_spend), 4) AS dining,
       sum(dining_txns) AS dining_n, row_number() OVER (ORDER BY month) AS pos
FROM {P} GROUP BY month""")
define("port_ratio", ("port",), """
SELECT a.month, round(sum(b.travel) FILTER (WHERE b.pos > a.pos - 3), 4)
       / nullif(round(sum(b.travel) FILTER (WHERE b.pos <= a.pos - 3), 4), 0) AS r
FROM port a JOIN port b ON b.pos BETWEEN a.pos - 5 AND a.pos GROUP BY a.month""")
define("sums3", (P,), f"""
SELECT customer_id, month, month_idx,
       round(sum(travel_spend) OVER (PARTITION BY customer_id ORDER BY month_idx ROWS 2 PRECEDING), 4) AS cur,
       round(sum(travel_spend) OVER (PARTITION BY customer_id ORDER BY month_idx
             ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING), 4) AS prior
FROM {P}""")
define("dining3", (P, "port"), f"""
SELECT x.customer_id, x.month, x.month_idx, x.dining_txns AS n0, y.dining_txns AS n1, z.dining_txns AS n2,
       x.dining_spend AS s0, z.dining_spend AS s2,
       x.dining_txns / nullif(px.dining_n, 0) AS r0, y.dining_txns / nullif(py.dining_n, 0) AS r1,
       z.dining_txns / nullif(pz.dining_n, 0) AS r2, px.dining AS p0, pz.dining AS p2
FROM {P} x
JOIN {P} y ON y.customer_id = x.customer_id AND y.month_idx = x.month_idx - 1
JOIN {P} z ON z.customer_id = x.customer_id AND z.month_idx = x.month_idx - 2
JOIN port px ON px.month = x.month JOIN port py ON py.month = y.month JOIN port pz ON pz.month = z.month""")

DEFAULT = dict(travel_drop_pct=0.5, travel_min_base=200.0, first_min=3, dining_min_base=2, dining_min_drop=0.5,
               cooldown=2, adjust=1)


def quiet(states: str, cooldown: int) -> str:
    return f"""
SELECT s.* FROM {states} s
WHERE NOT EXISTS (SELECT 1 FROM {states} e WHERE e.customer_id = s.customer_id
                  AND e.month_idx < s.month_idx AND e.month_idx >= s.month_idx - {cooldown})"""


def define_events(tag: str, panel: str = P, **changes) -> str:
    r = {**DEFAULT, **changes}
    expected = "prior * coalesce(r, 1)" if r["adjust"] else "prior"
    define(f"ts_{tag}", ("sums3", "port_ratio"), f"""
SELECT customer_id, month, month_idx, prior, cur, {expected} AS expected FROM sums3 JOIN port_ratio USING (month)
WHERE month_idx > 5 AND prior >= {r['travel_min_base']} AND cur < (1 - {r['travel_drop_pct']}) * ({expected})""")
    define(f"t_{tag}", (f"ts_{tag}",), quiet(f"ts_{tag}", r["cooldown"]))
    a, b, c = ("r0", "r1", "r2") if r["adjust"] else ("n0", "n1", "n2")
    define(f"ds_{tag}", ("dining3",), f"""
SELECT * FROM dining3 WHERE {a} < {b} AND {b} < {c} AND n2 >= {r['dining_min_base']}
  AND {a} <= (1 - {r['dining_min_drop']}) * {c}""")
    define(f"d_{tag}", (f"ds_{tag}",), quiet(f"ds_{tag}", r["cooldown"]))
    stake = "greatest(s2 * p0 / nullif(p2, 0) - s0, 0)" if r["adjust"] else "greatest(s2 - s0, 0)"
    define(f"f_{tag}", (panel,), f"""
SELECT customer_id, min(month) AS month, arg_min(travel_spend, month) AS amount
FROM {panel} WHERE travel_txns > 0 GROUP BY customer_id HAVING min(month_idx) > {r['first_min']}""")
    define(f"ev_{tag}", (f"t_{tag}", f"f_{tag}", f"d_{tag}"), f"""
SELECT customer_id, month, 'travel_drop' AS trigger_name, prior AS baseline_value, cur AS current_value,
       expected - cur AS spend_at_stake FROM t_{tag}
UNION ALL SELECT customer_id, month, 'first_travel', CAST(0 AS DOUBLE), amount, amount FROM f_{tag}
UNION ALL SELECT customer_id, month, 'dining_cooling', CAST(n2 AS DOUBLE), CAST(n0 AS DOUBLE), {stake} FROM d_{tag}""")
    return f"ev_{tag}"


define_events("base")
define_events("plain", adjust=0)
define_events("card", panel="panel_card")

define("names", (), "SELECT * FROM (VALUES ('travel_drop'), ('first_travel'), ('dining_cooling')) v(trigger_name)")
define("size", (P,), f"SELECT count(DISTINCT customer_id) AS people, count(DISTINCT month) AS months FROM {P}")


def _monthly(events: str) -> str:
    return build((events, "names", "size"), f"""
SELECT m.month, k.trigger_name, count(DISTINCT e.customer_id) AS customers_firing,
       coalesce(round(sum(e.spend_at_stake), 4), 0) AS spend_at_stake,
       count(DISTINCT e.customer_id) / (SELECT people FROM size) AS pct_of_customers
FROM (SELECT DISTINCT month FROM {P}) m CROSS JOIN names k
LEFT JOIN {events} e ON e.month = m.month AND e.trigger_name = k.trigger_name
GROUP BY m.month, k.trigger_name""")


define("flat", (P, "port"), f"""
SELECT p.customer_id, p.month, p.month_idx, p.txns, p.spend, p.travel_txns,
       p.travel_spend / nullif(q.travel / nullif(a.t, 0), 0) AS travel_spend,
       p.dining_spend / nullif(q.dining / nullif(a.d, 0), 0) AS dining_spend,
       p.dining_txns / nullif(q.dining_n / nullif(a.n, 0), 0) AS dining_txns
FROM {P} p JOIN port q USING (month)
CROSS JOIN (SELECT round(sum(travel), 4) / count(*) AS t, round(sum(dining), 4) / count(*) AS d,
                   sum(dining_n) / count(*) AS n FROM port) a""")

define("shuffled", ("flat",), """
SELECT rep, customer_id, travel_spend, dining_txns,
       row_number() OVER (PARTITION BY rep, customer_id ORDER BY h, month) AS month_idx
FROM (SELECT rep, flat.*,
             CASE WHEN rep = 0 THEN month_idx
                  ELSE CAST(concat('0x', substr(md5(concat_ws('|', 42, rep, customer_id, month)), 1, 8)) AS BIGINT)
             END AS h
      FROM flat CROSS JOIN range(21) g(rep))""")
define("sh_travel", ("shuffled",), """
SELECT * FROM (
  SELECT rep, customer_id, month_idx,
         round(sum(travel_spend) OVER (w ROWS 2 PRECEDING), 4) AS cur,
         round(sum(travel_spend) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING), 4) AS prior
  FROM shuffled WINDOW w AS (PARTITION BY rep, customer_id ORDER BY month_idx))
WHERE month_idx >= 6 AND prior >= 200 AND cur < 0.5 * prior""")
define("sh_dining", ("shuffled",), """
SELECT x.rep, x.customer_id, x.month_idx
FROM shuffled x JOIN shuffled y ON y.rep = x.rep AND y.customer_id = x.customer_id AND y.month_idx = x.month_idx - 1
JOIN shuffled z ON z.rep = x.rep AND z.customer_id = x.customer_id AND z.month_idx = x.month_idx - 2
WHERE x.dining_txns < y.dining_txns AND y.dining_txns < z.dining_txns AND z.dining_txns >= 2
  AND x.dining_txns <= 0.5 * z.dining_txns""")


def _rep_fires(states: str) -> str:
    return f"""
SELECT r.rep, count(s.rep) AS n FROM range(21) r(rep)
LEFT JOIN (SELECT a.rep FROM {states} a WHERE NOT EXISTS (
    SELECT 1 FROM {states} b WHERE b.rep = a.rep AND b.customer_id = a.customer_id
    AND b.month_idx BETWEEN a.month_idx - 2 AND a.month_idx - 1)) s ON s.rep = r.rep
GROUP BY r.rep"""


define("sh_fires", ("sh_travel", "sh_dining"), f"""
SELECT 'travel_drop' AS trigger_name, * FROM ({_rep_fires('sh_travel')})
UNION ALL SELECT 'dining_cooling', * FROM ({_rep_fires('sh_dining')})""")


def _follow(events: str, scope: str) -> str:
    def one(trigger, col, base, now, after, reach):
        def span(lo, hi):
            return f"avg(w.{col}) FILTER (WHERE w.month_idx - i.month_idx BETWEEN {lo} AND {hi})"
        return f"""
SELECT '{trigger}' AS trigger_name, {span(*base)} AS b, {span(*now)} AS n, {span(*after)} AS a, avg(w.{col}) AS l
FROM {events} e JOIN flat i ON i.customer_id = e.customer_id AND i.month = e.month
JOIN flat w ON w.customer_id = e.customer_id
WHERE e.trigger_name = '{trigger}' AND i.month_idx + {reach} <= (SELECT max(month_idx) FROM flat)
GROUP BY e.customer_id, e.month"""
    return f"""
SELECT '{scope}' AS scope, trigger_name, count(*) AS events_with_follow_up, CAST(1 AS DOUBLE) AS baseline_index,
       round(sum(n) / sum(b), 6) AS trigger_period_index, round(sum(a) / sum(b), 6) AS follow_up_index,
       round(sum(l) / sum(b), 6) AS long_run_index,
       round((sum(a) - sum(n)) / (sum(b) - sum(n)), 6) AS share_of_drop_recovered_unaided
FROM ({one('travel_drop', 'travel_spend', (-5, -3), (-2, 0), (1, 3), 3)}
      UNION ALL {one('dining_cooling', 'dining_txns', (-2, -2), (0, 0), (1, 2), 2)})
WHERE b IS NOT NULL AND n IS NOT NULL AND a IS NOT NULL AND l IS NOT NULL
GROUP BY trigger_name"""


define("ev_building", ("ev_base", "label_account"), """
SELECT e.* FROM ev_base e JOIN label_account l USING (customer_id) WHERE l.segment_name = 'BUILDING'""")

define("outcomes", ("ev_base", P), f"""
SELECT e.trigger_name, e.customer_id, e.month,
       round(coalesce(sum(CASE WHEN e.trigger_name = 'dining_cooling' THEN p.dining_spend ELSE p.travel_spend END), 0), 4)
         AS v
FROM ev_base e LEFT JOIN {P} p ON p.customer_id = e.customer_id
  AND p.month > e.month AND p.month <= e.month + INTERVAL 3 MONTH
GROUP BY ALL""")

_VARIANTS = {
    "Naive rule (no portfolio adjustment, no floors, no cooldown)": (
        dict(adjust=0, travel_min_base=0.01, dining_min_base=1, dining_min_drop=0.0, cooldown=0), "td"),
    "Default without portfolio adjustment": (dict(adjust=0, dining_min_base=4), "td"),
    "Default": (dict(dining_min_base=4), "tfd"),
    "Travel base $500": (dict(travel_min_base=500.0, dining_min_base=4), "t"),
    "Travel base $1,000": (dict(travel_min_base=1000.0, dining_min_base=4), "t"),
    "Dining base 6 transactions": (dict(dining_min_base=6), "d"),
    "First travel after 6 months of history": (dict(first_min=6), "f"),
}
_FULL = {"t": "travel_drop", "f": "first_travel", "d": "dining_cooling"}
_parts = []
for _i, (_label, (_changes, _which)) in enumerate(_VARIANTS.items()):
    define_events(f"v{_i}", **_changes)
    for _w in _which:
        _parts.append(f"SELECT '{_label}' AS variant, '{_FULL[_w]}' AS trigger_name, customer_id, month FROM {_w}_v{_i}")
_needs = tuple(f"{w}_v{i}" for i, (_, (_, which)) in enumerate(_VARIANTS.items()) for w in which)
define("variant_fires", _needs, "\nUNION ALL ".join(_parts))

_R6 = "round({0}, 6) AS {0}"

SQL = {
    "portfolio_month": build("port", """
SELECT month, travel AS travel_spend, dining AS dining_spend, CAST(dining_n AS BIGINT) AS dining_txns FROM port"""),
    "trigger_travel_drop": build("ev_base", "SELECT * FROM ev_base WHERE trigger_name = 'travel_drop'"),
    "trigger_dining_cooling": build("ev_base", "SELECT * FROM ev_base WHERE trigger_name = 'dining_cooling'"),
    "trigger_first_travel": build("f_card", """
SELECT customer_id, month, 'first_travel' AS trigger_name, CAST(0 AS DOUBLE) AS baseline_value,
       amount AS current_value, amount AS spend_at_stake FROM f_card"""),
    "trigger_events": build("ev_base", "SELECT * FROM ev_base"),
    "trigger_events_unadjusted": build("ev_plain", "SELECT * FROM ev_plain"),
    "backtest_monthly": _monthly("ev_base"),
    "backtest_monthly_unadjusted": _monthly("ev_plain"),
    "trigger_summary": build(("ev_base", "names", "size"), """
SELECT trigger_name, count(customer_id) AS fires, count(DISTINCT customer_id) AS customers,
       coalesce(round(sum(spend_at_stake), 4), 0) AS spend_at_stake,
       round(coalesce(median(spend_at_stake), 0), 6) AS median_stake_per_fire,
       count(DISTINCT customer_id) / (SELECT people FROM size) AS pct_customers_ever_firing,
       count(customer_id) / (SELECT months FROM size) AS avg_fires_per_month
FROM names LEFT JOIN ev_base USING (trigger_name) GROUP BY trigger_name"""),
    "trigger_overlap": build("ev_base", """
SELECT a AS trigger_a, b AS trigger_b, same_month AS same_month_both,
       same_month / greatest(1, least(na, nb)) AS same_month_share_of_smaller,
       both_ever AS customers_ever_both, ca + cb - both_ever AS customers_ever_either,
       both_ever / greatest(1, ca + cb - both_ever) AS customer_jaccard
FROM (SELECT p.a, p.b,
    (SELECT count(*) FROM ev_base x JOIN ev_base y USING (customer_id, month)
     WHERE x.trigger_name = p.a AND y.trigger_name = p.b) AS same_month,
    (SELECT count(*) FROM ev_base WHERE trigger_name = p.a) AS na,
    (SELECT count(*) FROM ev_base WHERE trigger_name = p.b) AS nb,
    (SELECT count(DISTINCT customer_id) FROM ev_base WHERE trigger_name = p.a) AS ca,
    (SELECT count(DISTINCT customer_id) FROM ev_base WHERE trigger_name = p.b) AS cb,
    (SELECT count(DISTINCT x.customer_id) FROM ev_base x JOIN ev_base y USING (customer_id)
     WHERE x.trigger_name = p.a AND y.trigger_name = p.b) AS both_ever
  FROM (VALUES ('travel_drop', 'first_travel'), ('travel_drop', 'dining_cooling'),
               ('first_travel', 'dining_cooling')) p(a, b))"""),
    "deseasonalised_panel": build("flat", "SELECT * FROM flat"),
    "trigger_placebo": build("sh_fires", """
SELECT trigger_name, max(n) FILTER (WHERE rep = 0) AS actual_fires,
       avg(n) FILTER (WHERE rep > 0) AS placebo_fires_mean, min(n) FILTER (WHERE rep > 0) AS placebo_fires_min,
       max(n) FILTER (WHERE rep > 0) AS placebo_fires_max,
       max(n) FILTER (WHERE rep = 0) / avg(n) FILTER (WHERE rep > 0) AS actual_to_placebo_ratio
FROM sh_fires GROUP BY trigger_name"""),
    "trigger_follow_up": build(("ev_base", "ev_building", "flat"), _follow("ev_base", "All customers")
                               + "\nUNION ALL\n" + _follow("ev_building", "BUILDING only")),
    "trigger_holdout": build(("outcomes", "ev_base"), f"""
SELECT trigger_name, fpy AS fires_per_year, CAST(round_even(t, 0) AS BIGINT) AS treated,
       CAST(round_even(h, 0) AS BIGINT) AS holdout,
       CASE trigger_name WHEN 'dining_cooling' THEN 'dining_spend' ELSE 'travel_spend' END
         || ' in the 3 months after firing' AS outcome,
       round(m, 6) AS outcome_mean, round(sd, 6) AS outcome_sd,
       round(2.8 * sd * sqrt(1 / t + 1 / h), 6) AS min_detectable_lift_abs,
       round(2.8 * sd * sqrt(1 / t + 1 / h) / m, 6) AS min_detectable_lift_pct,
       CAST(ceil(7.84 * sd * sd * (1 / 0.9 + 1 / 0.1) / (0.1 * m * 0.1 * m)) AS BIGINT) AS fires_needed_for_10pct_lift
FROM (SELECT trigger_name, fpy, CAST(0.1 AS DOUBLE) * fpy AS h, fpy - CAST(0.1 AS DOUBLE) * fpy AS t, m, sd
  FROM (SELECT trigger_name, count(*) AS fpy FROM ev_base e
        WHERE year(month) = (SELECT max(year(month)) FROM ev_base x WHERE x.trigger_name = e.trigger_name)
        GROUP BY trigger_name)
  JOIN (SELECT trigger_name, avg(v) AS m, stddev_samp(v) AS sd FROM outcomes
        WHERE month + INTERVAL 3 MONTH <= (SELECT max(month) FROM {P}) GROUP BY trigger_name) USING (trigger_name))"""),
    "trigger_by_segment": build(("ev_base", "label_account"), """
SELECT e.segment_name, trigger_name, count(*) AS fires, count(DISTINCT customer_id) AS customers,
       round(sum(spend_at_stake), 4) AS spend_at_stake, any_value(n) AS segment_customers,
       count(DISTINCT customer_id) / any_value(n) AS pct_segment_ever_firing
FROM (SELECT * FROM ev_base JOIN label_account USING (customer_id)) e
JOIN (SELECT segment_name, count(*) AS n FROM label_account GROUP BY segment_name) s ON s.segment_name = e.segment_name
GROUP BY e.segment_name, trigger_name"""),
    "trigger_sensitivity": build("variant_fires", """
SELECT variant, trigger_name, CAST(sum(n) AS BIGINT) AS fires,
       (SELECT count(DISTINCT customer_id) FROM variant_fires c
        WHERE c.variant = f.variant AND c.trigger_name = f.trigger_name) AS customers,
       coalesce(sum(n) FILTER (WHERE month(month) IN (1, 2, 3)), 0) / sum(n) AS share_of_fires_in_jan_to_mar,
       max(n) AS peak_month_fires
FROM (SELECT variant, trigger_name, month, count(*) AS n FROM variant_fires GROUP BY ALL) f
GROUP BY variant, trigger_name"""),
}
