"""Payload files: what is read back, what is not opened, and the same as a stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barloom.sources import payloads as pay
from barloom.streaming import bars as sm
from conftest import collected

COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


@pytest.fixture(scope="module")
def written(spark, bars, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("payloads") / "p")
    pay.write_payloads(pay.to_payloads(bars.select(*COLUMNS)), path)
    return path


def test_all_bars_come_back(spark, bars, written):
    got = collected(pay.read_payloads(spark, written).select(*COLUMNS), ("symbol", "ts"))
    want = collected(bars.select(*COLUMNS), ("symbol", "ts"))
    assert got.equals(want)


def test_folders_outside_are_not_opened(spark, bars, written):
    start, end = dt.datetime(2024, 1, 20, 5), dt.datetime(2024, 1, 30, 6)
    some = pay.read_payloads(spark, written, symbols=["b", "missing"], start=start, end=end)
    want = bars.where("symbol = 'b'").where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    assert collected(some.select(*COLUMNS), ("symbol", "ts")).equals(collected(want.select(*COLUMNS), ("symbol", "ts")))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and plan.count("FileScan text") == 1
    opened = some.select(F.input_file_name().alias("f")).distinct().collect()
    chunks = {r["f"].split("chunk=")[1].split("/")[0] for r in opened}
    assert all("symbol=b" in r["f"] for r in opened) and chunks == {"2024-01-18", "2024-01-25"}
    # a folder that must not be opened may hold anything
    assert pay.read_payloads(spark, written, symbols=["missing"]).count() == 0


def test_one_scan_however_many_symbols(spark, bars, tmp_path):
    many = bars.where("symbol = 'c'").select(*COLUMNS).crossJoin(spark.range(200)).withColumn("symbol", F.concat("symbol", "id")).drop("id")
    pay.write_payloads(pay.to_payloads(many), str(tmp_path / "p"))
    back = pay.read_payloads(spark, str(tmp_path / "p"))
    assert back._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert back.count() == many.count() and back.rdd.getNumPartitions() < 100


def test_odd_payloads_and_zones(spark, tmp_path):
    candles = [{"time": 1704412800, "open": "1", "high": "2", "low": "0.5", "close": "1.5", "volume": None}, {"time": 1704416400, "open": "x", "high": "2", "low": "1", "close": "1", "volume": "3"}]
    lines = [json.dumps({"success": True, "result": candles}), json.dumps({"success": False, "result": candles}), "not json", "", json.dumps({"success": True, "result": []})]
    rows = spark.createDataFrame([(x, "a", dt.date(2024, 1, 4)) for x in lines], "body string, symbol string, chunk date")
    pay.write_payloads(rows, str(tmp_path / "p"))
    (only,) = pay.read_payloads(spark, str(tmp_path / "p")).collect()
    assert (only["symbol"], only["ts"], only["volume"]) == ("a", dt.datetime(2024, 1, 5), 0.0)
    # 05:30 on the clock of the zone; the range is on that clock too, and reaches chunks of the day before
    zone = {"time_zone": "Asia/Kolkata", "start": dt.datetime(2024, 1, 5, 5), "end": dt.datetime(2024, 1, 5, 6)}
    assert [r["ts"] for r in pay.read_payloads(spark, str(tmp_path / "p"), **zone).collect()] == [dt.datetime(2024, 1, 5, 5, 30)]


def test_a_stream_of_files_equals_the_table(spark, bars, written, tmp_path):
    stream = pay.stream_payloads(spark, written, symbols=["b", "c"], files_per_batch=2)
    sm.run_updates(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch_id").distinct().count() > 2
    want = collected(bars.where("symbol <> 'a'").select(*COLUMNS), ("symbol", "ts"))
    assert collected(out.select(*COLUMNS), ("symbol", "ts")).equals(want)
