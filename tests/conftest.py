"""A shared local session, and raw transactions from small spending grids."""
from __future__ import annotations

import os
import re
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spendweave.plans.workbench import Workbench, release_all  # noqa: E402
from spendweave.sources.schema import RAW_TRANSACTIONS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[*]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
               .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release_all()
    session.stop()


def grid_cells(text):
    """(customer, category, month offset, purchases, amount of each) from lines like ``7 travel: 300 . 2*45``.

    One word a month, a dot for none, ``n*a`` for n purchases of a; ``12: word`` repeats a word twelve times.
    """
    for line in filter(None, map(str.strip, text.splitlines())):
        head, _, months = line.partition(":")
        customer, category = head.split()
        words = re.sub(r"(\d+)\[([^\]]*)\]", lambda m: " ".join([m[2]] * int(m[1])), months).split()
        for offset, word in enumerate(words):
            if word != ".":
                times, _, amount = word.rpartition("*")
                yield int(customer), category, offset, int(times or 1), float(amount)


@pytest.fixture(scope="session")
def ledger(spark):
    """Raw transactions of a grid, expanded by Spark: a cell's purchases fall on different workdays and hours of its month."""
    def build(text, first_month="2021-03-01"):
        cells = spark.createDataFrame(list(grid_cells(text)), "cc_num long, category string, offset int, times int, amt double")
        month = F.add_months(F.lit(first_month).cast("date"), F.col("offset"))
        rows = (cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
                .withColumn("day", F.date_add(F.next_day(month, "Mon"), (F.col("i") % 5).cast("int"))))
        return rows.select(
            F.lit("grid").alias("source_file"), F.concat_ws("/", "cc_num", "category", "offset", "i").alias("trans_num"),
            (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(9) + F.col("i") % 8)).alias("trans_ts"),
            "cc_num", "category", "amt", F.lit("M").alias("gender"), F.lit(40_000).cast("long").alias("city_pop"),
            F.lit("1972-11-02").cast("date").alias("dob"), F.lit(0).alias("is_fraud"))
    return build


@pytest.fixture(scope="session")
def raw_frame(spark):
    return lambda rows: spark.createDataFrame(rows, RAW_TRANSACTIONS)


@pytest.fixture(scope="session")
def bench():
    """Lazy stages on a raw frame."""
    return lambda raw: Workbench(raw, durable=False)
