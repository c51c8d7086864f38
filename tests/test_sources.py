import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import dataset, predict
from barloom.operators import model_features as mf
from barloom.sources import bars as src
from barloom.sources import export as ex
from conftest import collected


def test_payloads(spark):
    good = {"success": True, "result": [
        {"time": 1704067200, "open": "1.5", "high": 2, "low": "1", "close": "1.75", "volume": None},
        {"time": 1704068100, "open": 1, "high": 1, "low": 1, "close": 1, "volume": ""},
        {"time": 1704069000, "open": 1, "high": 1, "low": 1, "close": 1, "volume": "7.5"}]}
    bodies = [good, {"success": False, "result": good["result"]}, {"success": True, "result": []}, {"success": True}]
    df = spark.createDataFrame([("x", json.dumps(b)) for b in bodies], "symbol string, body string")
    got = src.bars_from_payloads(df).orderBy("pos").toPandas()
    assert list(got["volume"]) == [0.0, 0.0, 7.5] and got["open"][0] == 1.5
    assert str(got["ts"][0]) == "2024-01-01 00:00:00"
    local = src.bars_from_payloads(df, time_zone="Asia/Kolkata").orderBy("pos").toPandas()
    assert str(local["ts"][0]) == "2024-01-01 05:30:00"


def test_first_chunk_wins(spark):
    rows = [("x", "2024-01-01 00:00:00", 1, 0, 10.0), ("x", "2024-01-01 00:00:00", 0, 5, 20.0), ("x", "2024-01-01 01:00:00", 1, 1, 30.0)]
    df = spark.createDataFrame(rows, "symbol string, ts string, chunk int, pos int, close double")
    got = src.first_of_duplicates(df, ["chunk", "pos"]).orderBy("ts").toPandas()
    assert list(got["close"]) == [20.0, 30.0]


def test_contract_and_columns(spark, bars):
    report = src.bar_contract(bars).toPandas()
    assert report.drop(columns=["symbol", "bars"]).to_numpy().sum() == 0
    bad = bars.where("symbol = 'c'").withColumn("close", F.when(F.col("rn") != 2, F.col("close"))).withColumn(
        "low", F.when(F.col("rn") == 3, F.lit(1e6)).otherwise(F.col("low"))
    )
    got = src.bar_contract(bad.unionByName(bad.where("rn = 4"))).toPandas().iloc[0]
    assert (got["null_price"], got["high_below_low"], got["duplicate_ts"]) == (1, 1, 1)
    with pytest.raises(ValueError):
        src.bar_contract(bars.drop("close"))


def test_manifest_counts_missing_bars(spark, bars):
    part = bars.where("symbol = 'b' and rn % 10 != 0")
    lit = lambda t: F.expr(f"timestamp_ntz'{t}'")
    got = src.backfill_manifest(part, lit("2024-01-01"), lit("2024-01-20"), 3600).orderBy("chunk").toPandas()
    assert list(got["expected"]) == [168, 168, 120] and got["missing"].sum() == 46
    wanted = spark.createDataFrame([("b",), ("nowhere",), ("nowhere",)], "symbol string")
    both = src.backfill_manifest(part, lit("2024-01-01"), lit("2024-01-20"), 3600, requested=wanted).toPandas()
    absent = both[both["symbol"] == "nowhere"]
    assert len(both) == 6 and absent["present"].sum() == 0 and absent["missing"].sum() == 456


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_files(spark, bars, bars_frame, tmp_path, fmt):
    path = str(tmp_path / fmt)
    src.write_bars(bars.select("symbol", "ts", *src.BAR_COLUMNS), path, fmt)
    back = src.read_bars(spark, path, fmt, symbols=["a", "b"])
    got = collected(back, ("symbol", "ts"))
    want = bars_frame[bars_frame["symbol"] != "c"].reset_index(drop=True)
    np.testing.assert_allclose(got["close"], want["close"])
    assert (got["ts"] == want["ts"]).all()


def test_json_has_no_non_finite_values(spark, tmp_path):
    df = spark.sql(
        "select double('nan') as a, array(1D, double('infinity')) as b, named_struct('c', float('-infinity')) as d, "
        "timestamp_ntz'2024-01-01 05:00:00' as t, map('k', double('nan')) as m, 1D as _hidden"
    )
    record = json.loads(ex.json_rows(df).first()[0])
    assert record == {"a": None, "b": [1.0, None], "d": {"c": None}, "t": "2024-01-01T05:00:00", "m": {"k": None}}
    path = str(tmp_path / "result")
    ex.ResultFolder(spark, symbol="x").add("rows", df).add("none", df.where("false")).set_meta(days=3).save(path)
    assert json.loads(spark.read.text(f"{path}/meta").first()[0]) == {"symbol": "x", "days": "3"}
    assert spark.read.text(f"{path}/none").count() == 0


def test_split_is_purged_and_scaled_on_train_only(bars):
    rows = dataset.with_split(mf.labeled_features(bars.where("symbol = 'b'"))).cache()
    got = collected(rows)
    train_end, val_end = int(880 * 0.7), int(880 * 0.85)
    for name, lo, hi in (("train", 59, train_end - 21), ("val", train_end, val_end - 21), ("test", val_end, 879)):
        part = got[got["split"] == name]["rn"]
        assert (part.min(), part.max()) == (lo, hi)
    scaled = collected(dataset.standardize(rows))
    head = scaled[scaled["rn"] < train_end]
    assert abs(head["rsi_14"].mean()) < 1e-9 and head["rsi_14"].std(ddof=0) == pytest.approx(1.0)
    windows = dataset.sequences(dataset.standardize(rows), window=60)
    assert windows.count() == 880 - 59
    row = windows.where("rn = 100").first()
    np.testing.assert_allclose([s[11] for s in row["sequence"]], scaled["rsi_14"][41:101], rtol=1e-5)


def test_model_is_saved_and_loaded(bars, tmp_path):
    from pyspark.ml import PipelineModel

    rows = dataset.standardize(dataset.with_split(mf.labeled_features(bars.where("symbol = 'b'")))).cache()
    model = predict.train(rows.where("split = 'train'"), max_iter=5)
    model.save(str(tmp_path / "model"))
    test = rows.where("split = 'test'")
    a = predict.score(model, test).toPandas()
    b = predict.score(PipelineModel.load(str(tmp_path / "model")), test).toPandas()
    np.testing.assert_allclose(a["p_up"], b["p_up"])
    assert a[["up_pred", "dn_pred"]].to_numpy().min() >= 0 and a[["up_pred", "dn_pred"]].to_numpy().max() <= 5
    np.testing.assert_allclose(a["p_up"], 1 / (1 + np.exp(-a["logit"])), rtol=1e-9)


def test_malformed_candles_are_reported_not_guessed(spark):
    from barloom.sources.bars import bars_from_payloads, malformed_candles

    body = (
        '{"success": true, "result": [{"time": 0, "open": "1", "high": "2", "low": "0.5", "close": "1.5", "volume": "abc"},'
        ' {"time": 60, "open": "n/a", "high": "2", "low": "1", "close": "1", "volume": "1"},'
        ' {"time": 120, "open": "1", "high": "2", "low": "1", "close": "1", "volume": ""},'
        ' {"time": 180, "open": "1", "high": "2", "low": "1", "close": "1", "volume": null}]}'
    )
    payloads = spark.createDataFrame([("a", body)], "symbol string, body string")
    assert [(r["pos"], r["volume"]) for r in bars_from_payloads(payloads).orderBy("pos").collect()] == [(2, 0.0), (3, 0.0)]
    assert [r["pos"] for r in malformed_candles(payloads).orderBy("pos").collect()] == [0, 1]
