"""Stages of one run, built on demand and shared between the results that need them."""
from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..config import TriggerRules
from ..operators import features, generations, holdout, panel, quantiles, segmentation, stats, transactions, triggers
from ..functions.session import width
from ..sources import adapter
from . import stages

PURCHASE_COLUMNS = ("trans_ts", "cc_num", "category", "amt", "gender", "city_pop", "dob", "is_fraud")
BUCKET_ROWS = 1_000_000         # raw rows for each bucket of a stage


class Workbench:
    """Feature stages on top of a raw transaction table.

    The source is read once, into a typed stage; all else reads that stage or what is made of it. Where nobody asked for the whole rows
    first, features start from a narrower stage without row ids and files, and whole rows asked for later are read again. Month facts are written
    before the panel is filled, so calendar months and the last day come from them. With ``durable=False`` everything stays
    lazy, which suits a single result on small data.
    """

    def __init__(self, raw: DataFrame, durable: bool = True):
        self.source = raw
        self.durable = durable
        self._events: dict[TriggerRules, DataFrame] = {}
        self._ledgers: dict[TriggerRules, holdout.Ledger] = {}

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return stages.keep(df, name, "customer_id", self.buckets) if self.durable else df

    @cached_property
    def buckets(self) -> int:
        """Buckets of the stages by customer: more of them for a large table, so no task sorts more than it can hold."""
        return max(width(self.source.sparkSession), math.ceil(self.purchases.count() / BUCKET_ROWS))

    @cached_property
    def raw(self) -> DataFrame:
        return stages.keep_rows(self.source, "raw") if self.durable else self.source

    @cached_property
    def transactions(self) -> DataFrame:
        return transactions.clean(self.raw)

    @cached_property
    def purchases(self) -> DataFrame:
        """What features need of the raw rows."""
        if "raw" in self.__dict__ or not self.durable:
            return self.raw
        return stages.keep_rows(self.source.select(*PURCHASE_COLUMNS), "purchases")

    @cached_property
    def facts(self) -> DataFrame:
        return self._keep(panel.month_facts(transactions.clean(self.purchases)), "facts")

    @cached_property
    def customers(self) -> DataFrame:
        return transactions.customers(self.purchases, self.facts.agg(F.max("last_txn_date").alias("data_end")))

    @cached_property
    def month_facts(self) -> DataFrame:
        """The zero-filled panel with every month fact."""
        return self._keep(panel.fill_months(self.facts, panel.months_present(self.facts)), "panel")

    @cached_property
    def customer_month(self) -> DataFrame:
        return self.month_facts.select(*panel.PANEL_COLUMNS)

    @cached_property
    def customer_quarter(self) -> DataFrame:
        return panel.customer_quarter(self.customer_month)

    def events(self, rules: TriggerRules = TriggerRules()) -> DataFrame:
        """All trigger events of a rule set, kept once for each."""
        if rules not in self._events:
            self._events[rules] = self._keep(triggers.trigger_events(self.customer_month, rules), "events")
        return self._events[rules]

    def arms(self, rules: TriggerRules, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(holdout ledger, every fire with its arm), made once for each rule set: the months up to the middle one are assigned
        first, those after it meet the ledger."""
        if rules not in self._ledgers:
            events = self.events(rules)
            ledger = holdout.Ledger(events.sparkSession, stages.new_name("ledger"))
            middle = F.lit(events.agg(F.percentile_approx(F.unix_date(F.col("month").cast("date")), 0.5)).first()[0])
            day = F.unix_date(F.col("month").cast("date"))
            ledger.assign(events.where(day <= middle), segments)
            ledger.assign(events.where(day > middle), segments)
            self._ledgers[rules] = ledger
        ledger = self._ledgers[rules]
        return ledger.table(), ledger.arms(self.events(rules))

    @cached_property
    def customer_features(self) -> DataFrame:
        hot = quantiles.find_hot_keys(self.month_facts)
        medians = quantiles.keyed_median(transactions.clean(self.purchases), "customer_id", "amt", "median_ticket", hot)
        table = features.customer_features(self.customers, self.month_facts, self.customer_quarter, medians)
        return self._keep(table, "features")

    @cached_property
    def cuts(self) -> tuple[int | None, int | None]:
        """The two age-band cuts, found once."""
        return generations.cut_values(self.customer_features)

    @cached_property
    def banded(self) -> DataFrame:
        return generations.with_buckets(self.customer_features, self.cuts)

    @cached_property
    def test_battery(self) -> DataFrame:
        """The generation tests: a row for each metric and test, kept because several results read it."""
        battery = generations.test_battery(self.banded)
        return stages.keep_rows(battery, "battery") if self.durable else battery

    @cached_property
    def intervals(self) -> DataFrame:
        """Bootstrap interval of each generation's medians, with the full number of resamples, kept."""
        found = stats.median_ci(self.customer_features, generations.METRICS, "generation", "customer_id")
        return stages.keep_rows(found, "intervals") if self.durable else found

    @cached_property
    def matrix(self) -> DataFrame:
        return segmentation.prepare_matrix(self.customer_features)

    @cached_property
    def kmeans(self) -> segmentation.Centres:
        """The segments' centres: the best of ten starts, fitted once."""
        return segmentation.fit_kmeans(self.matrix, config.CHOSEN_K)

    @cached_property
    def k_table(self) -> DataFrame:
        """Fit and stability of every number of segments, with the full number of starts and resamples, kept: a row each."""
        found = segmentation.select_k(self.matrix)
        return stages.keep_rows(found, "k_table") if self.durable else found

    def release(self) -> None:
        for stage in ("raw", "purchases", "facts", "month_facts", "customer_features", "test_battery", "intervals", "k_table"):
            if stage in self.__dict__ and self.durable and not (stage == "purchases" and self.purchases is self.__dict__.get("raw")):
                stages.forget(self.__dict__[stage])
        if self.durable:
            for kept in self._events.values():
                stages.forget(kept)
        for ledger in self._ledgers.values():
            ledger.drop()
        if "matrix" in self.__dict__:
            self.__dict__["matrix"].unpersist()


_benches: dict[tuple, Workbench] = {}


def bench_for(spark: SparkSession, sf_dir: str, grain: str) -> Workbench:
    """One workbench per session, data folder and grain."""
    key = (spark.sparkContext.applicationId, sf_dir, grain)
    if key not in _benches:
        _benches[key] = Workbench(adapter.raw_transactions(spark, sf_dir, grain))
    return _benches[key]


def release_all() -> None:
    for bench in _benches.values():
        bench.release()
    _benches.clear()
