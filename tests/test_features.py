"""Features against plain pandas on random purchases, and the edges of the bands."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendweave import config
from spendweave.functions import columns as C
from spendweave.operators import panel as P
from spendweave.operators import quality
from spendweave.plans import stages
from spendweave.plans import workbench
from spendweave.plans.workbench import Workbench


@pytest.fixture(scope="module")
def purchases():
    """600 random purchases of 14 customers over two and a half years; every ninth is flagged."""
    rng, n = np.random.default_rng(11), 600
    start = np.datetime64("2020-05-01T00:00:00")
    customer = rng.choice(np.arange(50, 64), n, p=np.array([30] + [5] * 13) / 95)
    return pd.DataFrame({
        "source_file": "f", "trans_num": [f"n{i}" for i in range(n)],
        "trans_ts": start + rng.integers(0, 900 * 86_400, n).astype("timedelta64[s]"), "cc_num": customer,
        "category": rng.choice(list(config.CATEGORY_TO_GROUP), n), "amt": np.round(rng.gamma(1.3, 60, n), 2),
        "gender": np.where(customer % 3 == 0, "F", "M"), "city_pop": customer * 10_000, "is_fraud": (np.arange(n) % 9 == 4).astype(int),
        "dob": [dt.date(1930 + int(c - 50) * 6, 2, 3) for c in customer]})


@pytest.fixture(scope="module")
def built(spark, purchases, raw_frame, bench):
    columns = ["source_file", "trans_num", "trans_ts", "cc_num", "category", "amt", "gender", "city_pop", "dob", "is_fraud"]
    rows = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in purchases[columns].astype(object).itertuples(index=False)]
    return bench(raw_frame(rows))


@pytest.fixture(scope="module")
def clean(purchases):
    out = purchases[purchases.is_fraud == 0].copy()
    out["group"] = out.category.map(config.CATEGORY_TO_GROUP)
    out["month"] = out.trans_ts.dt.to_period("M")
    return out


@pytest.fixture(scope="module")
def table(built):
    return {r["customer_id"]: r for r in built.customer_features.collect()}


def test_sums_shares_and_timing(clean, table):
    assert sorted(table) == sorted(clean.cc_num.unique())
    end = clean.trans_ts.max().normalize()
    for customer, part in clean.groupby("cc_num"):
        row, spend = table[customer], part.amt.sum()
        span = (part.month.max() - part.month.min()).n + 1
        tagged = part[part.category.str.endswith(("_net", "_pos"))]
        want = {
            "n_txns": len(part), "total_spend": spend, "active_months": span, "monthly_spend": spend / span, "avg_ticket": part.amt.mean(),
            "median_ticket": part.amt.median(), "recency_days": (end - part.trans_ts.max().normalize()).days,
            "weekend_share": (part.trans_ts.dt.dayofweek >= 5).mean(),
            "late_night_share": ((part.trans_ts.dt.hour >= 22) | (part.trans_ts.dt.hour < 5)).mean(),
            "online_share": tagged[tagged.category.str.endswith("_net")].amt.sum() / tagged.amt.sum() if len(tagged) else 0,
            "txns_travel_100plus": ((part.category == "travel") & (part.amt >= 100)).sum(),
            **{f"share_{g}": part[part.group == g].amt.sum() / spend for g in config.CATEGORY_GROUPS}}
        assert {k: row[k] for k in want} == pytest.approx(want), customer


def test_panel_volatility_and_active_shares(clean, built, table):
    every = sorted(clean.month.unique())
    by_month = clean.groupby(["cc_num", "month"]).amt.sum()
    panel = {}
    for r in built.customer_month.collect():
        panel.setdefault(r["customer_id"], []).append((r["month_idx"], r["month"], r["spend"], r["travel_txns"], r["dining_txns"]))
    for customer, part in clean.groupby("cc_num"):
        months = [m for m in every if part.month.min() <= m <= part.month.max()]
        rows = sorted(panel[customer])
        assert [r[0] for r in rows] == list(range(1, len(months) + 1))
        spend = [by_month.get((customer, m), 0.0) for m in months]
        assert [r[2] for r in rows] == pytest.approx(spend)
        cv = np.std(spend, ddof=1) / np.mean(spend) if len(spend) > 1 else 0
        assert table[customer]["spend_volatility"] == pytest.approx(cv)
        for column, place in (("travel_active_month_share", 3), ("dining_active_month_share", 4)):
            assert table[customer][column] == pytest.approx(np.mean([r[place] > 0 for r in rows]))
        big = part[(part.category == "travel") & (part.amt >= 100)].trans_ts.dt.year.nunique()
        assert table[customer]["travel_active_year_share"] == pytest.approx(big / part.trans_ts.dt.year.nunique())


def test_quarters(clean, built):
    want = clean.groupby(["cc_num", clean.trans_ts.dt.to_period("Q")]).amt.sum()
    rows = built.customer_quarter.orderBy("customer_id", "quarter").collect()
    by_customer = {}
    for r in rows:
        by_customer.setdefault(r["customer_id"], []).append(r)
    for customer, quarters in by_customer.items():
        for i, r in enumerate(quarters):
            assert r["spend"] == pytest.approx(want.get((customer, pd.Period(r["quarter"], "Q")), 0.0))
            for lag, name in ((1, "qoq_spend_change"), (4, "yoy_spend_change")):
                base = quarters[i - lag]["spend"] if i >= lag else None
                assert r[name] == (pytest.approx(r["spend"] / base - 1) if base else None)


def test_bands_at_every_birth_year_and_size(spark):
    years = spark.range(1900, 2020).select("id", C.generation("id").alias("g")).collect()
    last = config.GENERATION_LAST_YEAR
    for r in years:
        assert r["g"] == next((g for g in config.GENERATIONS[:-1] if r["id"] <= last[g]), config.GENERATIONS[-1])
    sizes = spark.createDataFrame([(n + d,) for n in (2_500, 25_000, 250_000) for d in (-1, 0)], "n long")
    assert [r[0][0] for r in sizes.select(C.city_size_band("n")).collect()] == list("122334")


def test_months_that_nobody_used_stay_out(ledger, bench):
    alone = bench(ledger("1 home: 20 . 30"))
    assert [(r["month_idx"], r["spend"]) for r in alone.customer_month.orderBy("month").collect()] == [(1, 20), (2, 30)]
    together = bench(ledger("1 home: 20 . 30\n2 home: . 5 ."))
    rows = together.customer_month.where("customer_id = 1").orderBy("month").collect()
    assert [(r["month_idx"], r["spend"]) for r in rows] == [(1, 20), (2, 0), (3, 30)]


def test_filled_months_are_numbered_without_a_window(ledger, bench):
    """The window goes over the month facts; nothing sorts the rows that fill the gaps, and places skip months nobody used."""
    made = bench(ledger("1 home: 20 . . . . 30 . 5\n2 home: . . 4 . . . 6 .\n3 home: . . . . 7 7 . ."))
    plan = made.month_facts._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Generate explode(sequence(")
    assert below.count("Window [") and not [line for line in above.splitlines() if "Window [" in line and "customer_id" in line]
    got = {c: [] for c in (1, 2, 3)}
    for r in made.customer_month.orderBy("customer_id", "month").collect():
        got[r["customer_id"]].append((r["month_idx"], r["month"].month, r["spend"]))
    assert got == {1: [(1, 3, 20), (2, 5, 0), (3, 7, 0), (4, 8, 30), (5, 9, 0), (6, 10, 5)],
                   2: [(1, 5, 4), (2, 7, 0), (3, 8, 0), (4, 9, 6)], 3: [(1, 7, 7), (2, 8, 7)]}


def test_dimension_reports_contradictions(raw_frame, bench):
    def row(customer, gender, dob):
        return ("f", f"{customer}{gender}{dob}", dt.datetime(2022, 6, 1, 8), customer, "home", 3.0, gender, 9, dob, 0)
    day = dt.date(2001, 7, 7)
    got = {r["customer_id"]: r for r in bench(raw_frame([row(1, "F", day), row(1, "M", day), row(2, "F", day), row(2, "F", day)])).customers.collect()}
    assert (got[1]["attributes_consistent"], got[2]["attributes_consistent"], got[2]["age_at_end"]) == (False, True, 21)


def test_quality_checks(ledger, bench):
    good = bench(ledger("1 home: 5 5\n2 travel: 7 7"))
    assert len(good.customer_features.columns) == 38
    quality.require_clean(quality.report(good.customer_features, good.transactions, good.customers))
    with pytest.raises(quality.QualityError, match="duplicate_customers"):
        quality.require_clean(quality.feature_violations(good.customer_features.union(good.customer_features)))
    with pytest.raises(quality.QualityError, match="unmapped"):
        quality.require_clean(quality.unmapped(bench(ledger("1 lottery: 5")).transactions))


def test_stages_read_the_source_once_and_go_away(spark, tmp_path, ledger):
    """Panel and features come from one scan of the source files: they can be deleted before the features are built."""
    import shutil
    ledger("1 home: 5 6 7\n2 travel: 7 . 9").write.parquet(f"{tmp_path}/raw")
    made = Workbench(spark.read.parquet(f"{tmp_path}/raw"))
    assert made.raw.count() == 5
    shutil.rmtree(f"{tmp_path}/raw")
    assert made.customer_features.count() == 2 and made.month_facts.count() == 6
    plan = P.customer_quarter(made.customer_month)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan                                          # bucketed by customer
    made.release()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith((stages.PREFIX + "features", stages.PREFIX + "facts"))]


def test_headroom_without_a_benchmark(spark):
    rows = [(0.0, 0.2), (0.05, 0.2), (0.2, 0.2), (0.7, 0.2), (0.0, 0.0), (0.3, 0.0), (None, 0.2), (0.3, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "s double, b double").select(C.headroom("s", "b")).collect()]
    assert got == [1.0, 0.75, 0.0, 0.0, 0.0, 0.0, None, None]
    assert [r[0] for r in spark.createDataFrame([(-1.0,), (2.0,), (None,)], "v double").select(C.clip01("v")).collect()] == [0.0, 1.0, None]


def test_nobody_spends_in_a_category(spark):
    """Benchmark zero: the one customer who does spend there has no headroom."""
    from spendweave.operators import targeting
    rows = [("idle", 500.0, 0.0, 0.0, 20.0, 0.5)] * 19 + [("diner", 500.0, 250.0, 1.0, 20.0, 0.5)]
    customers = spark.createDataFrame(rows, "segment_name string, monthly_spend double, monthly_dining_spend double, dining_active_month_share double, "
                                            "monthly_travel_spend double, travel_active_year_share double")
    got = {r["segment_name"]: r for r in targeting.score_segments(customers).where("benefit = 'dining_credit'").collect()}
    assert got["diner"]["headroom"] == 0 and got["idle"]["headroom"] == 0 and got["idle"]["headroom_benchmark_share"] == 0
    assert customers.agg(F.max("monthly_dining_spend")).first()[0] == 250


def test_features_start_from_a_narrow_stage_in_buckets_that_follow_the_rows(spark, ledger, tmp_path, monkeypatch):
    """Row ids are not staged for features; a stage has a bucket for so many rows; the result is that of whole rows."""
    ledger("1 travel: 300 . 2*45\n2 home: 20 30 40\n3 food_dining: 4*5 9").write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    monkeypatch.setattr(workbench, "BUCKET_ROWS", 1)
    made, whole = Workbench(raw), Workbench(raw, durable=False)
    assert made.customer_features.orderBy("customer_id").collect() == whole.customer_features.orderBy("customer_id").collect()
    assert "trans_num" not in made.purchases.columns and "raw" not in made.__dict__
    assert made.buckets == raw.count() and made.facts.rdd.getNumPartitions() >= 1
    made.release()
    rows_first = Workbench(raw)
    assert rows_first.raw.count() == raw.count() and rows_first.purchases is rows_first.raw
    rows_first.release()
