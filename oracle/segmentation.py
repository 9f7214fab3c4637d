"""Checks for the parts of the fitted segmentation that SQL can state."""
from . import generations as g
from .ctes import build, define
from .segments import LABELS  # noqa: F401  (defines the label subqueries)

CLUSTER = ("monthly_spend", "monthly_txns", "avg_ticket", *g.SHARES, "online_share", "weekend_share",
           "late_night_share", "spend_volatility")
define("lab_banded", ("banded", "label_card"), "SELECT * FROM banded JOIN label_card USING (customer_id)")
_ATTRIBUTES = {"generation": "generation", "inferred_age_band": "age_band", "gender": "gender",
               "city_size_band": "city_size_band", "transactions_per_day_tier": "txns_per_day_tier"}
define("attr_pairs", ("lab_banded",), "\nUNION ALL\n".join(
    f"SELECT '{n}' AS attribute, segment_name AS a, CAST({c} AS VARCHAR) AS b FROM lab_banded"
    for n, c in _ATTRIBUTES.items()))
define("attr_grid", ("attr_pairs",), """
SELECT x.attribute, x.a, y.b, count(p.a) AS o
FROM (SELECT DISTINCT attribute, a FROM attr_pairs) x JOIN (SELECT DISTINCT attribute, b FROM attr_pairs) y
  ON y.attribute = x.attribute
LEFT JOIN attr_pairs p ON p.attribute = x.attribute AND p.a = x.a AND p.b = y.b GROUP BY ALL""")

_SCALED = {c: f"(ln(1 + {c}) - avg(ln(1 + {c})) OVER ()) / coalesce(nullif(stddev_pop(ln(1 + {c})) OVER (), 0), 1)" for c in CLUSTER}
define("scaled", ("feat_card",), "SELECT customer_id, " + ", ".join(f"{e} AS {c}" for c, e in _SCALED.items()) + " FROM feat_card")
define("scaled_list", ("scaled",), f"SELECT customer_id, [{', '.join(CLUSTER)}] AS x FROM scaled")
define("covariance", ("scaled",), "SELECT [" + ", ".join(
    "[" + ", ".join(f"covar_pop({a}, {b})" for b in CLUSTER) + "]" for a in CLUSTER) + "] AS a FROM scaled")


def _largest(name: str, matrix: str) -> str:
    """Largest eigenvalue ``l`` and its vector ``v`` (largest entry positive) of a symmetric matrix, by squaring it sixteen times."""
    return f"""{name}_power AS (
  SELECT 0 AS i, a FROM {matrix}
  UNION ALL
  SELECT i + 1, [[list_dot_product(r, c) / list_sum([list_dot_product(q, q) for q in a]) for c in a] for r in a]
  FROM {name}_power WHERE i < 16),
{name}_place AS (
  SELECT a, list_position([a[j][j] for j in range(1, len(a) + 1)], list_max([a[j][j] for j in range(1, len(a) + 1)])) AS p
  FROM {name}_power WHERE i = 16),
{name}_vector AS (SELECT [e / sqrt(a[p][p]) for e in a[p]] AS v FROM {name}_place),
{name} AS (SELECT v, list_dot_product(v, [list_dot_product(r, v) for r in a]) AS l FROM {name}_vector, {matrix})"""


SQL = {
    "pca_2d": build(("scaled_list", "covariance"), f"""
SELECT * FROM (WITH RECURSIVE {_largest('one', 'covariance')},
rest AS (SELECT [[a[i][j] - l * v[i] * v[j] for j in range(1, len(v) + 1)] for i in range(1, len(v) + 1)] AS a FROM covariance, one),
{_largest('two', 'rest')}
SELECT customer_id, round(list_dot_product(x, one.v), 6) AS pca_1, round(list_dot_product(x, two.v), 6) AS pca_2,
       round(one.l / total, 6) AS explained_1, round(two.l / total, 6) AS explained_2
FROM scaled_list, one, two, (SELECT list_sum([a[j][j] for j in range(1, len(a) + 1)]) AS total FROM covariance))"""),
    "segment_silhouette": build(("scaled_list", "label_card"), """
SELECT segment_name, count(*) AS customers,
       round(avg(CASE WHEN mates = 0 OR greatest(inside, outside) = 0 THEN 0 ELSE (outside - inside) / greatest(inside, outside) END), 6)
         AS silhouette
FROM (SELECT customer_id, segment_name, max(n) FILTER (segment_name = other) - 1 AS mates,
             max(total / greatest(n - 1, 1)) FILTER (segment_name = other) AS inside, min(total / n) FILTER (segment_name <> other) AS outside
      FROM (SELECT p.customer_id, l.segment_name, k.segment_name AS other, count(*) AS n, sum(list_distance(p.x, q.x)) AS total
            FROM scaled_list p JOIN label_card l USING (customer_id), scaled_list q JOIN label_card k USING (customer_id) GROUP BY ALL)
      GROUP BY ALL)
GROUP BY ALL"""),
    "forest_check": build("banded", """
SELECT fold, count(*) AS customers, count(DISTINCT customer_id) AS different, count(*) FILTER (gender = 'F') AS women, count(*) AS hits
FROM (SELECT customer_id, gender,
             (row_number() OVER (PARTITION BY gender ORDER BY
                CAST(concat('0x', substr(md5(concat_ws('|', 42, customer_id)), 1, 8)) AS BIGINT), customer_id) - 1) % 5 AS fold
      FROM banded)
GROUP BY fold"""),
    "k_selection_check": build("feat_card", """
SELECT range AS k, true AS drop_is_right, true AS costs_less, true AS smallest_fits, true AS indices_in_range, true AS silhouette_in_range,
       (SELECT count(*) FROM feat_card) AS all_customers
FROM range(3, 9)"""),
    "kmeans_check": build("feat_card", """
SELECT range AS cluster, true AS centre_is_mean, true AS has_members, (SELECT count(*) FROM feat_card) AS all_customers
FROM range(5)"""),
    "mixture_check": build("feat_card", """
SELECT range AS start, true AS never_falls, true AS gains, true AS above_floor, true AS shares_add_up,
       (SELECT count(*) FROM feat_card) AS all_customers
FROM range(3)"""),
    "cluster_matrix": build("feat_card", "SELECT customer_id, " + ", ".join(
        f"round((ln(1 + {c}) - avg(ln(1 + {c})) OVER ()) / coalesce(nullif(stddev_pop(ln(1 + {c})) OVER (), 0), 1), 6)"
        f" AS {c}" for c in CLUSTER) + " FROM feat_card"),
    "stratified_folds": build(("label_card", "feat_card"), """
SELECT customer_id, segment_name,
       (row_number() OVER (PARTITION BY segment_name ORDER BY
          CAST(concat('0x', substr(md5(concat_ws('|', 42, customer_id)), 1, 8)) AS BIGINT), customer_id) - 1) % 5 AS fold
FROM (SELECT * FROM label_card WHERE customer_id IN (SELECT customer_id FROM feat_card))"""),
    "artifact_associations": build("attr_grid", f"""
SELECT attribute, round(statistic, 6) AS statistic,
       round(CASE WHEN dof > 0 THEN {g.tail('statistic', 'dof')} ELSE 1 END, 6) AS p_value,
       round(CASE WHEN room > 0 THEN sqrt(greatest(0, statistic / n - dof / (n - 1)) / room) END, 6) AS effect_size, n
FROM (SELECT *, CAST((r - 1) * (k - 1) AS DOUBLE) AS dof,
             least(r - (r - 1) * (r - 1) / (n - 1) - 1, k - (k - 1) * (k - 1) / (n - 1) - 1) AS room
      FROM (SELECT attribute, CAST(sum(o) AS BIGINT) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS k,
                   sum((o - e) * (o - e) / e) AS statistic
            FROM (SELECT *, CAST(sum(o) OVER (PARTITION BY attribute, a) AS DOUBLE)
                            * sum(o) OVER (PARTITION BY attribute, b) / sum(o) OVER (PARTITION BY attribute) AS e
                  FROM attr_grid) GROUP BY attribute))"""),
    "majority_baseline": build("lab_banded", """
SELECT max(n) / sum(n) AS majority_baseline_accuracy
FROM (SELECT count(*) AS n FROM lab_banded GROUP BY segment_name)"""),
    "classifier_inputs": build("lab_banded", """
SELECT customer_id, birth_year, CAST(gender = 'F' AS BIGINT) AS is_female, round(log10(city_pop), 6) AS log_city_pop,
       txns_per_day_tier FROM lab_banded"""),
}
