"""One offer per customer and month, and the lift of the treated over the held-out customers."""
import datetime
import random

import numpy as np
import pytest

from spendweave.operators import contacts

STATES = "customer_id long, month date, month_idx long, trigger_name string, spend_at_stake double"
RESULTS = "segment_name string, trigger_name string, customer_id long, held_out boolean, before double, after double"


def random_states(seed, customers=60, months=24):
    rng = random.Random(seed)
    return [(c, datetime.date(2022 + m // 12, m % 12 + 1, 1), m + 1, t, float(rng.randint(1, 99)))
            for c in range(customers) for m in range(months) for t in contacts.PRIORITY if rng.random() < 0.3]


def walk(states, cooldown, priority):
    """Month by month: what fires, what is sent, what stays pending."""
    out, last = [], {}
    for customer, month, idx in sorted({s[:3] for s in states}):
        here = {s[3]: s[4] for s in states if s[:3] == (customer, month, idx)}
        fires = [t for t in priority if t in here and idx - last.get((customer, t), -10 ** 6) > cooldown]
        out += [(customer, month, t, here[t], t == fires[0], None if t == fires[0] else fires[0]) for t in fires]
        last.update({(customer, t): idx for t in here if t not in fires[1:]})
    return sorted(out, key=lambda r: r[:3])


@pytest.mark.parametrize("cooldown, priority", [(2, contacts.PRIORITY), (0, contacts.PRIORITY), (4, contacts.PRIORITY[::-1]), (1, ("dining_cooling", "travel_drop"))])
def test_against_a_walk_through_the_months(spark, cooldown, priority):
    rows = random_states(cooldown)
    got = contacts.arbitrate(spark.createDataFrame(rows, STATES).repartition(7), cooldown, priority).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:3]) == walk(rows, cooldown, priority)
    sent = [(r.customer_id, r.month) for r in got if r.sent]
    assert len(sent) == len(set(sent)) and any(not r.sent for r in got)


def test_an_outranked_fire_comes_back(spark):
    day = [datetime.date(2022, m, 1) for m in range(1, 5)]
    rows = [(1, day[0], 1, "travel_drop", 9.0), (1, day[0], 1, "dining_cooling", 5.0), (1, day[1], 2, "travel_drop", 9.0), (1, day[1], 2, "dining_cooling", 6.0),
            (1, day[2], 3, "dining_cooling", 7.0)]
    got = contacts.arbitrate(spark.createDataFrame(rows, STATES), 2).orderBy("month", "trigger_name").collect()
    assert [(r.month, r.trigger_name, r.sent, r.outranked_by) for r in got] == [
        (day[0], "dining_cooling", False, "travel_drop"), (day[0], "travel_drop", True, None), (day[1], "dining_cooling", True, None)]


def test_no_states(spark):
    assert contacts.arbitrate(spark.createDataFrame([], STATES), 2).count() == 0


def regression(rows, covariate=True):
    """Arm coefficient and its HC1 error by matrices."""
    t, x, y = (np.array(c, float) for c in zip(*[(not r[3], r[4], r[5]) for r in rows]))
    z = np.column_stack([np.ones(len(t)), t] + [x] * covariate)
    inverse = np.linalg.inv(z.T @ z)
    beta = inverse @ z.T @ y
    meat = (z * ((y - z @ beta) ** 2)[:, None]).T @ z
    return beta[1], np.sqrt((inverse @ meat @ inverse)[1, 1] * len(t) / (len(t) - z.shape[1]))


def test_lift_equals_matrix_regression(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        held, before = bool(rng.random() < 0.1), float(rng.gamma(2, 300))
        after = 0.8 * before + (0 if held else 50) + float(rng.normal(0, 20 + 0.1 * before))
        rows.append(("large" if i % 3 else None, ("travel_drop", "dining_cooling")[i % 2], i, held, before, after))
    got = contacts.lift(spark.createDataFrame(rows, RESULTS).repartition(9)).collect()
    assert len(got) == 4
    for r in got:
        own = [x for x in rows if (x[0], x[1]) == (r.segment_name, r.trigger_name)]
        lift, error = regression(own)
        assert (r.lift, r.std_error) == pytest.approx((lift, error))
        assert r.ci_low < r.lift < r.ci_high and r.std_error < r.plain_std_error        # the covariate narrows the interval
        assert r.treated + r.held_out == len(own)
        assert r.plain_lift == pytest.approx(np.mean([x[5] for x in own if not x[3]]) - np.mean([x[5] for x in own if x[3]]))


def test_lift_where_a_regression_is_not_possible(spark):
    rows = [("one arm", "a", 1, False, 3.0, 4.0), ("one arm", "a", 2, False, 5.0, 8.0), ("alone", "a", 3, True, 3.0, 4.0),
            ("told", "a", 4, True, 1.0, 4.0), ("told", "a", 5, False, 2.0, 7.0), ("told", "a", 6, True, 1.0, 2.0), ("told", "a", 7, False, 2.0, 9.0),
            *[("flat", "a", 10 + i, i % 2 == 0, 5.0, float(i)) for i in range(8)], ("flat", "a", 30, None, 5.0, 99.0), ("flat", "a", 31, True, 5.0, None)]
    got = {r.segment_name: r for r in contacts.lift(spark.createDataFrame(rows, RESULTS)).collect()}
    assert got["one arm"].lift is None and got["alone"].lift is None and got["alone"].ci_low is None
    for name in ("told", "flat"):                   # the covariate tells the arm, or has no spread: left out
        lift, error = regression([r for r in rows if r[0] == name and None not in r], covariate=False)
        assert (got[name].lift, got[name].std_error) == pytest.approx((lift, error))
    assert contacts.lift(spark.createDataFrame([], RESULTS)).count() == 0
