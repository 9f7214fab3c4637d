"""Checks for the group comparison.

Ranks come from rank() plus half the ties; tails of the chi-square from the closed form for even degrees of freedom.
"""
from .ctes import GROUPS, build, define

SHARES = tuple(f"share_{g}" for g in GROUPS)
METRICS = (*SHARES, "online_share", "avg_ticket", "median_ticket", "monthly_txns", "monthly_spend", "weekend_share",
           "late_night_share")


def tail(x: str, dof: str) -> str:
    """1 - P(dof/2, x/2) by the series of the incomplete gamma function; beyond 300 it is zero to many digits."""
    return (f"CASE WHEN ({x}) / 2 > 300 THEN 0 ELSE 1 - list_sum(list_transform(range(600), lambda j: "
            f"exp((({dof}) / 2 + j) * ln(greatest(({x}) / 2, 1e-300)) - ({x}) / 2 - lgamma(({dof}) / 2 + j + 1)))) END")


define("yearly", ("feat_card",), """
SELECT birth_year AS y, count(*) AS n, round(sum(late_night_share), 9) AS s FROM feat_card GROUP BY birth_year""")
define("cut_scan", ("yearly",), """
SELECT c.y AS yr, (SELECT min(y) FROM yearly WHERE y > c.y) AS nxt,
       sum(b.s) FILTER (WHERE b.y <= c.y) AS sl, sum(b.n) FILTER (WHERE b.y <= c.y) AS nl, sum(b.s) AS s, sum(b.n) AS n
FROM yearly c CROSS JOIN yearly b GROUP BY c.y""")
define("cut1", ("cut_scan",), """
SELECT yr, floor((yr + nxt) / 2) AS cut FROM cut_scan WHERE nxt IS NOT NULL
ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n DESC, yr LIMIT 1""")
define("cut2", ("yearly", "cut1"), """
SELECT floor((yr + nxt) / 2) AS cut FROM (
  SELECT c.y AS yr, min(b.y) FILTER (WHERE b.y > c.y) AS nxt, sum(b.s) FILTER (WHERE b.y <= c.y) AS sl,
         sum(b.n) FILTER (WHERE b.y <= c.y) AS nl, sum(b.s) AS s, sum(b.n) AS n
  FROM yearly c JOIN yearly b ON (b.y <= (SELECT yr FROM cut1)) = (c.y <= (SELECT yr FROM cut1)) GROUP BY c.y)
WHERE nxt IS NOT NULL
ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n DESC, yr LIMIT 1""")
define("cuts", ("cut1", "cut2"), """
SELECT CAST(least(a.cut, b.cut) AS BIGINT) AS first_cut, CAST(greatest(a.cut, b.cut) AS BIGINT) AS second_cut
FROM cut1 a, cut2 b""")
_top = " ".join(f"WHEN {s} = greatest({', '.join(SHARES)}) THEN '{g}'" for s, g in zip(SHARES, GROUPS))
define("banded", ("feat_card", "cuts"), f"""
SELECT f.*, CASE WHEN birth_year > second_cut THEN 'Younger band' WHEN birth_year > first_cut THEN 'Middle band'
                 ELSE 'Older band' END AS age_band,
       CAST(round_even(n_txns / (active_months * CAST(30.44 AS DOUBLE)), 0) AS BIGINT) AS txns_per_day_tier,
       CASE {_top} END AS top_category_group
FROM feat_card f CROSS JOIN cuts""")
define("long", ("banded",), f"""
UNPIVOT (SELECT customer_id, generation, age_band, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in METRICS)}
         FROM banded) ON {', '.join(METRICS)} INTO NAME metric VALUE v""")


def kw(name: str, source: str, keys: str, group: str) -> str:
    """Kruskal-Wallis per key set as a CTE called ``name``."""
    define(f"{name}_rank", (source,), f"""
SELECT {keys}, {group} AS g, v, rank() OVER (PARTITION BY {keys} ORDER BY v)
       + (count(*) OVER (PARTITION BY {keys}, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY {keys}, v) AS t
FROM {source}""")
    define(name, (f"{name}_rank",), f"""
SELECT {keys}, h AS statistic, {tail('h', 'k - 1')} AS p_value, h / (n - 1) AS effect_size, CAST(n AS BIGINT) AS n
FROM (SELECT {keys}, sum(gn) AS n, count(*) AS k,
        (12 / (CAST(sum(gn) AS DOUBLE) * (sum(gn) + 1)) * sum(gr * gr / gn) - 3 * (sum(gn) + 1))
        / (1 - sum(gt) / (CAST(sum(gn) AS DOUBLE) ** 3 - sum(gn))) AS h
      FROM (SELECT {keys}, g, count(*) AS gn, sum(r) AS gr, sum(CAST(t AS DOUBLE) * t - 1) AS gt
            FROM {name}_rank GROUP BY {keys}, g) GROUP BY {keys}) WHERE k >= 2""")
    return name


kw("kw_gen", "long", "metric", "generation")
kw("kw_band", "long", "metric", "age_band")
define("long_kept", ("long",), """
SELECT * FROM long WHERE (age_band, generation) IN (
  SELECT (age_band, generation) FROM long WHERE metric = 'avg_ticket' GROUP BY age_band, generation HAVING count(*) >= 20)""")
kw("kw_within", "long_kept", "age_band, metric", "generation")
define("pairs", ("banded",), """
SELECT 'top_category_group' AS metric, 'generation' AS compared_by, generation AS a, top_category_group AS b FROM banded
UNION ALL SELECT 'top_category_group', 'age_band', age_band, top_category_group FROM banded
UNION ALL SELECT 'txns_per_day_tier', 'generation', generation, CAST(txns_per_day_tier AS VARCHAR) FROM banded
UNION ALL SELECT 'txns_per_day_tier', 'age_band', age_band, CAST(txns_per_day_tier AS VARCHAR) FROM banded""")
define("grid", ("pairs",), """
SELECT metric, compared_by, a, b, count(p.a2) AS o FROM (
  SELECT x.metric, x.compared_by, x.a, y.b FROM (SELECT DISTINCT metric, compared_by, a FROM pairs) x
  JOIN (SELECT DISTINCT metric, compared_by, b FROM pairs) y USING (metric, compared_by))
LEFT JOIN (SELECT metric, compared_by, a, b, a AS a2 FROM pairs) p USING (metric, compared_by, a, b) GROUP BY ALL""")
define("chi", ("grid",), f"""
SELECT metric, compared_by, statistic, CASE WHEN dof > 0 THEN {tail('statistic', 'dof')} ELSE 1 END AS p_value,
       CASE WHEN room > 0 THEN sqrt(greatest(0, statistic / n - dof / (n - 1)) / room) END AS effect_size, n
FROM (SELECT *, CAST((r - 1) * (k - 1) AS DOUBLE) AS dof,
             least(r - (r - 1) * (r - 1) / (n - 1) - 1, k - (k - 1) * (k - 1) / (n - 1) - 1) AS room
      FROM (SELECT metric, compared_by, CAST(sum(o) AS BIGINT) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS k,
                   sum((o - e) * (o - e) / e) AS statistic
            FROM (SELECT *, CAST(sum(o) OVER (PARTITION BY metric, compared_by, a) AS DOUBLE)
                            * sum(o) OVER (PARTITION BY metric, compared_by, b) / sum(o) OVER (PARTITION BY metric, compared_by) AS e
                  FROM grid) GROUP BY metric, compared_by))""")
define("battery_raw", ("kw_gen", "kw_band", "kw_within", "chi"), """
SELECT metric, 'Kruskal-Wallis' AS test, g.statistic, g.p_value, g.effect_size, 'epsilon squared' AS effect_measure,
       b.effect_size AS effect_by_age_band, w.e AS effect_within_age_band
FROM kw_gen g JOIN kw_band b USING (metric)
LEFT JOIN (SELECT metric, sum(effect_size * n) / sum(n) AS e FROM kw_within GROUP BY metric) w USING (metric)
UNION ALL
SELECT x.metric, 'Chi-square', x.statistic, x.p_value, x.effect_size, 'Cramer''s V', y.effect_size, NULL
FROM chi x JOIN chi y ON y.metric = x.metric AND y.compared_by = 'age_band' WHERE x.compared_by = 'generation'""")


def holm(source: str) -> str:
    """Adjusted p: the largest (m - rank + 1) * p among tests with a p no larger."""
    return f"""(SELECT least(1, max((m.total - m.k + 1) * m.p)) FROM (
        SELECT p_value AS p, rank() OVER (ORDER BY p_value) AS k, count(*) OVER () AS total FROM {source}) m
      WHERE m.p <= t.p_value)"""


define("battery", ("battery_raw",), f"""
SELECT t.*, {holm('battery_raw')} AS p_holm,
       CASE WHEN effect_measure <> 'epsilon squared' THEN '' WHEN effect_size IS NULL THEN 'n/a'
            WHEN effect_size >= 0.14 THEN 'large' WHEN effect_size >= 0.06 THEN 'medium'
            WHEN effect_size >= 0.01 THEN 'small' ELSE 'negligible' END AS effect_label
FROM battery_raw t""")

# bootstrap: same hash-drawn rows for every metric of a generation
define("numbered", ("feat_card",), f"""
SELECT generation, row_number() OVER (PARTITION BY generation ORDER BY customer_id) - 1 AS idx, {', '.join(METRICS)}
FROM feat_card""")
def _mixed(tag: str, source: str, start: str, carry: str) -> str:
    """CTEs that scramble a 32-bit number in steps; the last one is ``tag``."""
    return (f"{tag}0 AS (SELECT {carry}, ({start}) % 4294967296::UBIGINT AS x FROM {source}),"
            f"{tag}1 AS (SELECT {carry}, (xor(x, x >> 16) * 2246822507::UBIGINT) % 4294967296::UBIGINT AS x FROM {tag}0),"
            f"{tag}2 AS (SELECT {carry}, (xor(x, x >> 13) * 3266489909::UBIGINT) % 4294967296::UBIGINT AS x FROM {tag}1),"
            f"{tag} AS (SELECT {carry}, xor(x, x >> 16) AS {tag}_x FROM {tag}2)")


# generations of up to 65,536 customers, which one range holds; larger ones divide their draws by binomials first
define("draws", ("feat_card",), f"""
WITH reps AS (SELECT rep::UBIGINT AS rep FROM range(2000) r(rep)),
{_mixed('a', 'reps', '42 * 2654435761::UBIGINT + rep', 'rep')},
{_mixed('b', 'a', 'a_x + 2246822519::UBIGINT', 'rep')},
every AS (SELECT generation, n, rep, b_x, unnest(range(n))::UBIGINT AS draw
          FROM (SELECT generation, count(*) AS n FROM feat_card GROUP BY generation) CROSS JOIN b),
{_mixed('c', 'every', 'b_x + (draw * 2654435769::UBIGINT) % 4294967296::UBIGINT', 'generation, n, rep')}
SELECT generation, rep, ((c_x * n) >> 32)::BIGINT AS idx FROM c""")
define("boot", ("numbered", "draws"), f"""
SELECT generation, rep, {', '.join(f'median({m}) AS {m}' for m in METRICS)}
FROM draws JOIN numbered USING (generation, idx) GROUP BY generation, rep""")
define("gen_summary", ("long",), """
SELECT generation, metric, count(*) AS n_customers, round(avg(v), 6) AS mean, round(median(v), 6) AS median
FROM long GROUP BY generation, metric""")

_R = "round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, round(effect_size, 6) AS effect_size"
_GENS = ("Silent", "Boomers", "Gen X", "Millennials", "Gen Z")

SQL = {
    "age_band_cuts": build("cuts", "SELECT * FROM cuts"),
    "customer_buckets": build("banded", "SELECT customer_id, age_band, txns_per_day_tier FROM banded"),
    "generation_summary": build("gen_summary", "SELECT * FROM gen_summary"),
    "generation_median_ci": build("boot", "\nUNION ALL\n".join(f"""
SELECT generation, '{m}' AS metric, round(quantile_cont({m}, 0.025), 6) AS median_ci_low,
       round(quantile_cont({m}, 0.975), 6) AS median_ci_high FROM boot GROUP BY generation""".strip() for m in METRICS)),
    "kruskal_by_generation": build("kw_gen", f"SELECT metric, n, {_R} FROM kw_gen"),
    "kruskal_within_band": build("kw_within", f"SELECT age_band, metric, n, {_R} FROM kw_within"),
    "cramers_v": build("chi", f"SELECT metric, compared_by, n, {_R} FROM chi"),
    "holm": build("kw_gen", f"""
SELECT metric, round(p_value, 6) AS p_value, round({holm('kw_gen')}, 6) AS p_holm FROM kw_gen t"""),
    "generation_tests": build("battery", f"""
SELECT metric, test, {_R}, effect_measure, round(effect_by_age_band, 6) AS effect_by_age_band,
       round(effect_within_age_band, 6) AS effect_within_age_band, round(p_holm, 6) AS p_holm, effect_label
FROM battery"""),
    "artifact_summary": build(("battery", "cuts"), """
SELECT round(median(effect_size), 6) AS median_effect_by_generation,
       round(median(effect_by_age_band), 6) AS median_effect_by_age_band,
       round(median(effect_within_age_band), 6) AS median_effect_within_age_band,
       round(max(effect_within_age_band), 6) AS max_effect_within_age_band,
       any_value(first_cut) AS first_cut, any_value(second_cut) AS second_cut
FROM battery CROSS JOIN cuts WHERE test = 'Kruskal-Wallis'"""),
    "generation_band_mix": build("banded", """
SELECT generation, count(*) FILTER (WHERE age_band = 'Older band') AS "Older band",
       count(*) FILTER (WHERE age_band = 'Middle band') AS "Middle band",
       count(*) FILTER (WHERE age_band = 'Younger band') AS "Younger band" FROM banded GROUP BY generation"""),
    "generation_insight_inputs": build(("gen_summary", "battery"), f"""
SELECT metric, {', '.join(f"max(s.median) FILTER (WHERE s.generation = '{g}') AS " + chr(34) + g + chr(34) for g in _GENS)},
       round(any_value(b.effect_size), 6) AS effect_size, round(any_value(b.p_value), 6) AS p_value
FROM gen_summary s JOIN battery b USING (metric) GROUP BY metric"""),
}
