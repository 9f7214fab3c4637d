"""Arms of the holdout ledger."""
import datetime
import random
import uuid
from collections import Counter

import pytest

from spendweave.operators import holdout

EVENTS = "customer_id long, month date, trigger_name string, spend_at_stake double"


@pytest.fixture
def ledger(spark):
    made = []

    def new():
        made.append(holdout.Ledger(spark, f"test_ledger_{uuid.uuid4().hex[:8]}"))
        return made[-1]
    yield new
    for x in made:
        x.drop()


def fires(seed=3, customers=900):
    rng = random.Random(seed)
    return [(c, datetime.date(2023, rng.randint(1, 6), 1), rng.choice(["travel_drop", "dining_cooling", "first_travel"]), 5.0)
            for c in range(customers) for _ in range(rng.randint(0, 3))]


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame([(c, "large" if c % 3 else "small") for c in range(800)], "customer_id long, segment_name string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_batches_by_month_make_no_difference(spark, ledger, segments):
    events = fires()
    at_once, by_month = ledger(), ledger()
    at_once.assign(spark.createDataFrame(events, EVENTS).repartition(5), segments)
    for month in range(1, 7):
        seen = {r.customer_id: r for r in by_month.table().collect()}
        by_month.assign(spark.createDataFrame([e for e in events if e[1].month == month], EVENTS), segments)
        now = {r.customer_id: r for r in by_month.table().collect()}
        assert all(now[c] == r for c, r in seen.items())                 # no earlier row changes
    assert rows(at_once.table()) == rows(by_month.table())
    again = rows(by_month.table())
    by_month.assign(spark.createDataFrame(events, EVENTS), segments.selectExpr("customer_id", "'moved' AS segment_name"))
    assert rows(by_month.table()) == again                               # a batch run again, other segments: nothing new


def test_share_is_exact_in_each_segment(spark, ledger, segments):
    made = ledger()
    table = made.assign(spark.createDataFrame(fires(), EVENTS), segments).collect()
    assert {r.segment_name for r in table} == {"large", "small", holdout.NO_SEGMENT}
    for name, n in Counter(r.segment_name for r in table).items():
        own = sorted((r for r in table if r.segment_name == name), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(n)) and sum(r.held_out for r in own) == n // 10
        assert [r.first_month for r in own] == sorted(r.first_month for r in own)
    first = {}
    for c, month, trigger, _ in fires():
        first[c] = min(first.get(c, (month, trigger)), (month, trigger))
    assert {r.customer_id: (r.first_month, r.first_trigger) for r in table} == first


def test_later_fires_keep_the_arm(spark, ledger, segments):
    made, events = ledger(), spark.createDataFrame(fires(), EVENTS)
    made.assign(events, segments)
    arms = made.arms(events)
    assert arms.count() == events.count()
    assert arms.groupBy("customer_id").agg({"held_out": "max"}).count() == arms.select("customer_id", "held_out").distinct().count()
    total = holdout.balance(arms).agg({"fires": "sum"}).first()[0]
    assert total == events.count()


def test_ledger_side_has_no_exchange(spark, ledger, segments):
    made = ledger()
    made.assign(spark.createDataFrame(fires(), EVENTS), segments)
    fresh = holdout.first_fires(spark.createDataFrame(fires(4), EVENTS)).join(made.table().select("customer_id").hint("merge"), "customer_id", "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    ledger_part = plan[plan.index(made.name):] if made.name in plan else plan
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and ledger_part


def test_empty_batches(spark, ledger, segments):
    made, none = ledger(), spark.createDataFrame([], EVENTS)
    assert made.assign(none, segments).count() == 0
    assert made.assign(spark.createDataFrame([(None, None, None, None), (5, datetime.date(2023, 1, 1), "travel_drop", None)], EVENTS), segments.limit(0)).count() == 1
