"""Checks for the holdout arms (one ranking over all months, where the engine assigns in batches), for contacts (recursion over months,
where the engine folds a customer's states) and for the lift (regression on residuals, where the engine solves the normal equations)."""
from . import triggers  # noqa: F401  (defines the events)
from .ctes import build, define

define("arms", ("ev_base", "label_account"), """
SELECT *, (place + 1) * 100 // 1000 > place * 100 // 1000 AS held_out
FROM (SELECT customer_id, segment_name, first_month, first_trigger,
             row_number() OVER (PARTITION BY segment_name ORDER BY first_month,
               CAST(concat('0x', substr(md5(concat_ws('|', 42, customer_id)), 1, 8)) AS BIGINT), customer_id) - 1 AS place
      FROM (SELECT customer_id, min(month) AS first_month FROM ev_base GROUP BY customer_id)
      JOIN (SELECT customer_id, month AS first_month, min(trigger_name) AS first_trigger FROM ev_base GROUP BY ALL) USING (customer_id, first_month)
      LEFT JOIN label_account USING (customer_id))""")

define("contact_states", ("ts_base", "f_base", "ds_base", "panel_account"), """
SELECT p.customer_id, p.month, p.month_idx AS m, t.expected - t.cur AS stake1, f.amount AS stake2,
       greatest(d.s2 * d.p0 / nullif(d.p2, 0) - d.s0, 0) AS stake3,
       t.month IS NOT NULL AS s1, f.month IS NOT NULL AS s2, d.month IS NOT NULL AS s3
FROM panel_account p LEFT JOIN ts_base t ON t.customer_id = p.customer_id AND t.month = p.month
LEFT JOIN f_base f ON f.customer_id = p.customer_id AND f.month = p.month
LEFT JOIN ds_base d ON d.customer_id = p.customer_id AND d.month = p.month""")
_NAMES = ("travel_drop", "first_travel", "dining_cooling")
_FIRES = [f"(s.s{i} AND s.m - w.l{i} > 2)" for i in (1, 2, 3)]
_WINNER = f"CASE WHEN {_FIRES[0]} THEN 1 WHEN {_FIRES[1]} THEN 2 WHEN {_FIRES[2]} THEN 3 END"
_LAST = ", ".join(f"CASE WHEN s.s{i} AND NOT ({f} AND {_WINNER} <> {i}) THEN s.m ELSE w.l{i} END" for i, f in zip((1, 2, 3), _FIRES))

SQL = {
    "contact_arbitration": build("contact_states", f"""
, walk(customer_id, month, m, f1, f2, f3, winner, l1, l2, l3) AS (
  SELECT customer_id, CAST(NULL AS TIMESTAMP), min(m) - 1, false, false, false, NULL::INT, -1000000::BIGINT, -1000000::BIGINT, -1000000::BIGINT
  FROM contact_states GROUP BY customer_id
  UNION ALL
  SELECT s.customer_id, CAST(s.month AS TIMESTAMP), s.m, {", ".join(_FIRES)}, {_WINNER}, {_LAST}
  FROM walk w JOIN contact_states s ON s.customer_id = w.customer_id AND s.m = w.m + 1)
""" + " UNION ALL ".join(f"""
SELECT customer_id, s.month, '{n}' AS trigger_name, round(CAST(stake{i} AS DOUBLE), 4) AS spend_at_stake, winner = {i} AS sent,
       CASE WHEN winner <> {i} THEN ['{"', '".join(_NAMES)}'][winner] END AS outranked_by
FROM walk w JOIN contact_states s USING (customer_id, m) WHERE f{i}""" for i, n in enumerate(_NAMES, 1))).replace("WITH ", "WITH RECURSIVE ", 1).replace(
        ")\n, walk(", "),\nwalk(").replace("),\n,", "),\n"),
    "lift_readout": build(("arms", "ev_base", "panel_account"), """
, fired AS (
  SELECT coalesce(segment_name, '') AS segment_name, trigger_name, customer_id, held_out, min(month) AS month
  FROM ev_base JOIN arms USING (customer_id) GROUP BY ALL),
around AS (
  SELECT f.segment_name, f.trigger_name, f.customer_id, CAST(NOT held_out AS DOUBLE) AS t,
         round(coalesce(sum(CASE WHEN trigger_name = 'dining_cooling' THEN dining_spend ELSE travel_spend END)
                        FILTER (WHERE p.month < f.month AND p.month >= f.month - INTERVAL 3 MONTH), 0), 4) AS x,
         round(coalesce(sum(CASE WHEN trigger_name = 'dining_cooling' THEN dining_spend ELSE travel_spend END)
                        FILTER (WHERE p.month > f.month AND p.month <= f.month + INTERVAL 3 MONTH), 0), 4) AS y
  FROM fired f JOIN panel_account p ON p.customer_id = f.customer_id
  WHERE f.month + INTERVAL 3 MONTH <= (SELECT max(month) FROM panel_account) GROUP BY f.segment_name, f.trigger_name, f.customer_id, held_out),
both_scopes AS (SELECT * FROM around UNION ALL SELECT 'All segments', trigger_name, customer_id, t, x, y FROM around),
fitted AS (
  SELECT segment_name, trigger_name, count(*) AS n, avg(t) AS mt, avg(x) AS mx, avg(y) AS my,
         count(*) FILTER (WHERE t = 1) AS treated, count(*) FILTER (WHERE t = 0) AS held_out,
         avg(y) FILTER (WHERE t = 1) AS y1, avg(y) FILTER (WHERE t = 0) AS y0,
         var_samp(y) FILTER (WHERE t = 1) AS v1, var_samp(y) FILTER (WHERE t = 0) AS v0,
         var_pop(x) > 0 AND var_pop(t) > 0 AND var_pop(t) * var_pop(x) - covar_pop(t, x) ^ 2 > 1e-9 * var_pop(t) * var_pop(x) AS adjusts,
         covar_pop(t, x) / nullif(var_pop(x), 0) AS tx, covar_pop(y, x) / nullif(var_pop(x), 0) AS yx
  FROM both_scopes GROUP BY ALL),
bare AS (
  SELECT r.segment_name, r.trigger_name, f.adjusts, r.t - mt - CASE WHEN adjusts THEN tx * (x - mx) ELSE 0 END AS u,
         r.y - my - CASE WHEN adjusts THEN yx * (x - mx) ELSE 0 END AS v
  FROM both_scopes r JOIN fitted f USING (segment_name, trigger_name)),
slope AS (SELECT segment_name, trigger_name, sum(u * v) / nullif(sum(u * u), 0) AS b, sum(u * u) AS ss FROM bare GROUP BY ALL),
sandwich AS (
  SELECT segment_name, trigger_name, b, ss, sum(u * u * (v - b * u) * (v - b * u)) AS meat
  FROM bare JOIN slope USING (segment_name, trigger_name) GROUP BY ALL),
errors AS (
  SELECT *, sqrt(CASE WHEN ss > 0 AND n > CASE WHEN adjusts THEN 3 ELSE 2 END
                      THEN n / (n - CASE WHEN adjusts THEN 3 ELSE 2 END) * meat / (ss * ss) END) AS se
  FROM fitted JOIN sandwich USING (segment_name, trigger_name))
SELECT segment_name, trigger_name, treated, held_out, round(y1, 4) AS treated_mean, round(y0, 4) AS holdout_mean,
       round(y1 - y0, 4) AS plain_lift, round(sqrt(v1 / treated + v0 / held_out), 4) AS plain_std_error,
       round(b, 4) AS lift, round(se, 4) AS std_error, round(b - 1.959963984540054 * se, 4) AS ci_low,
       round(b + 1.959963984540054 * se, 4) AS ci_high
FROM errors""").replace(")\n, fired", "),\nfired"),
    "holdout_assignment": build("arms", """
SELECT customer_id, coalesce(segment_name, '') AS segment_name, CAST(first_month AS DATE) AS first_month, first_trigger, place, held_out FROM arms"""),
    "holdout_balance": build(("arms", "ev_base"), """
SELECT coalesce(segment_name, '') AS segment_name, trigger_name, held_out, count(DISTINCT customer_id) AS customers, count(*) AS fires,
       round(sum(spend_at_stake), 4) AS spend_at_stake
FROM ev_base JOIN arms USING (customer_id) GROUP BY ALL"""),
}
