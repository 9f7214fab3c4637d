"""Files in and out, the catalogue and the full rebuild."""
import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendweave.operators import quality, segments
from spendweave.plans.rebuild import Effort, rebuild
from spendweave.config import TriggerRules
from spendweave.sources import adapter, catalog, files
from spendweave.sources.schema import RAW_TRANSACTIONS

A = "trans_date_trans_time,cc_num,category,amt,gender,city_pop,dob,trans_num,is_fraud\n"
B = "extra,trans_num,is_fraud,amt,category,cc_num,trans_date_trans_time,dob,city_pop,gender\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_files_with_different_layouts(spark, tmp_path):
    write(tmp_path / "one.csv", A + "2019-01-01 00:00:18,4512828414483801773,travel,4.97,F,3495,1988-03-09,t1,0\n")
    write(tmp_path / "two.csv", B + "x,t2,1,10.5,misc_net,7,2020-06-21 12:14:25,1990-01-01,12,M\n")
    df = files.read_raw_csv(spark, f"{tmp_path}/*.csv")
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in RAW_TRANSACTIONS]
    rows = {r["trans_num"]: r for r in df.collect()}
    assert rows["t1"]["cc_num"] == 4512828414483801773 and rows["t1"]["source_file"] == "one.csv"
    assert rows["t1"]["trans_ts"] == dt.datetime(2019, 1, 1, 0, 0, 18)
    assert (rows["t2"]["amt"], rows["t2"]["category"], rows["t2"]["is_fraud"]) == (10.5, "misc_net", 1)


def bytes_read(spark, work):
    """What all file systems of the session's JVM read meanwhile."""
    def total():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = total()
    return work(), total() - before


def test_headers_cost_the_heads_only(spark, tmp_path):
    line = "2019-01-01 00:00:18,4512828414483801773,travel,4.97,F,3495,1988-03-09,t1,0\n"
    for name, head, rows in (("short", A, 2), ("long", B, 600_000), ("longer", A, 900_000)):
        (tmp_path / f"{name}.csv").write_text(head + line * rows)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "only.csv").write_text(A)
    found, read = bytes_read(spark, lambda: files.first_lines(spark, f"{tmp_path}/*.csv"))
    assert [(path.rsplit("/", 1)[1], line + "\n") for path, line in found] == [
        ("long.csv", B), ("longer.csv", A), ("only.csv", A), ("short.csv", A)]
    assert (tmp_path / "longer.csv").stat().st_size > 60_000_000 and 0 < read < 1_000_000
    df, read = bytes_read(spark, lambda: files.read_raw_csv(spark, f"{tmp_path}/*.csv"))        # planned, not yet read
    assert df.columns == RAW_TRANSACTIONS.names and 0 < read < 1_000_000
    packed = tmp_path / "packed"
    packed.mkdir()
    with gzip.open(packed / "a b.csv.gz", "wt") as f:
        f.write(A + line)
    assert [r["trans_num"] for r in files.read_raw_csv(spark, str(packed)).collect()] == ["t1"]


def test_files_without_a_line_have_no_rows(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    df = files.read_raw_csv(spark, f"{tmp_path}/*.csv")
    assert df.schema == RAW_TRANSACTIONS and df.count() == 0


def test_a_bad_value_stops_the_load(spark, tmp_path):
    write(tmp_path / "bad.csv", A + "2019-01-01 00:00:18,notanumber,travel,4.97,F,3495,1988-03-09,t1,0\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_raw_csv(spark, f"{tmp_path}/bad.csv").collect()
    text = spark.createDataFrame([("1",), ("x",)], "amt string")
    with pytest.raises(Exception, match="bad value in amt"):
        files.cast_all(text, T.StructType([T.StructField("amt", T.DoubleType())])).collect()


def test_csv_sink_writes_six_decimals_and_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1 / 3, 7, dt.date(2019, 1, 1)), ("plain", None, None, None)],
                               "name string, share double, n long, month date")
    catalog.save_csv(df, str(tmp_path), "t")
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    assert "0.333333" in text and "0.3333333" not in text
    back = catalog.load_csv(spark, str(tmp_path), "t")
    assert back.schema == df.schema
    rows = {r["name"]: r for r in back.collect()}
    assert rows["a, b"]["month"] == dt.date(2019, 1, 1) and rows["plain"]["share"] is None


def test_parquet_json_and_views(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.5, 2.5])], "k long, v array<double>")
    files.write_parquet(df, f"{tmp_path}/p")
    files.write_json(df, f"{tmp_path}/j")
    assert files.read_parquet(spark, f"{tmp_path}/p").collect() == df.collect()
    assert files.read_json(spark, f"{tmp_path}/j", df.schema).collect() == df.collect()
    files.register(df, "some_frame")
    assert spark.sql("SELECT sum(k) AS s FROM some_frame").first()["s"] == 1


def test_repeated_names_can_stop_the_rebuild(spark, tmp_path, monkeypatch):
    raw = adapter.raw_transactions(spark, "/root/testdata/sf0.001", "card")
    light = Effort(resamples=2, placebo=1, ks=(3,), chosen_k=6, starts=1, bootstraps=1, bootstrap_starts=1,
                   mixture_starts=1, trees=1, depth=1)
    monkeypatch.setattr(segments, "rule_name", lambda: F.lit("one name"))
    with pytest.raises(quality.QualityError, match="repeated segment_name"):
        rebuild(raw, str(tmp_path), TriggerRules(dining_min_base=1), light, repeated_names="stop")
    assert not (tmp_path / "segment_profiles").exists()


def test_full_rebuild_and_catalogue(spark, tmp_path):
    raw = adapter.raw_transactions(spark, "/root/testdata/sf0.001", "card")
    light = Effort(resamples=5, placebo=2, ks=(3,), chosen_k=3, starts=1, bootstraps=1, bootstrap_starts=1,
                   mixture_starts=1, trees=3, depth=3)
    rebuild(raw, str(tmp_path), TriggerRules(dining_min_base=1), light, repeated_names="number")
    tables = catalog.load_all(spark, str(tmp_path))
    n = spark.read.parquet(f"{tmp_path}/customer_features").count()
    assert tables["features"].count() == n == tables["segment_assignments"].count()
    assert {"segment_name", "age_band", "txns_per_day_tier"} <= set(tables["features"].columns)
    assert tables["generation_tests"].count() == 17 and tables["k_selection"].count() == 1
    assert tables["trigger_params"].first()["holdout_share"] == 0.1
    assert tables["trigger_events"].count() == tables["trigger_summary"].groupBy().sum("fires").first()[0]
    assert tables["trigger_backtest_monthly"].count() % 3 == 0
