import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import resample as rs
from barloom.operators import series as sr
from barloom.streaming import bars as sm
from barloom.streaming.context import Bin, closed_up_to, coarse, followed, live_context
from barloom.streaming.indicators import running_indicators, state_after
from conftest import collected, walk


def stream_in_three(spark, frame, path, columns):
    """Files in time order, read one per batch."""
    edges = [0, 300, 600, 900]
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        frame.where(f"rn >= {lo} and rn < {hi}").select(*columns).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    schema = frame.select(*columns).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


BARS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def test_running_indicators_over_batches_equal_the_batch(spark, bars, tmp_path):
    some = bars.where("symbol = 'b'")
    stream = stream_in_three(spark, some, str(tmp_path / "in"), BARS)
    sm.run_updates(running_indicators(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = collected(spark.read.parquet(str(tmp_path / "out")), ("symbol", "ts"))
    assert got["batch_id"].nunique() == 3
    want = collected(sr.basic_indicators(some))
    np.testing.assert_allclose(got["atr"], want["atr"], rtol=1e-9)
    np.testing.assert_allclose(got["rsi"], want["rsi"], rtol=1e-7)
    ema = collected(sr.smoothed(some, {"ema": ("close", 2 / 22, 21)}))
    np.testing.assert_allclose(got["ema"], ema["ema"], rtol=1e-12)


def test_late_repeated_and_unordered_bars_equal_the_batch(spark, bars, tmp_path):
    """Five batches: bars come shuffled, a batch late, twice, and one far too late; the first bars came before the stream."""
    rng = np.random.default_rng(4)
    some = collected(bars.where("symbol <> 'a'"), ("symbol", "ts"))
    stream = some[(some["rn"] >= 100) | (some["symbol"] == "c")].copy()
    stream["batch"] = (stream["rn"] // 180 + rng.integers(0, 2, len(stream))).clip(0, 4)
    again = stream.sample(frac=0.3, random_state=1).assign(batch=lambda x: (x["batch"] + rng.integers(0, 2, len(x))).clip(0, 4))
    old = some[(some["symbol"] == "b") & (some["rn"] == 5)].assign(batch=4, close=1.0)
    sent = pd.concat([stream, again, old]).sample(frac=1.0, random_state=2)
    schema = bars.select(*BARS).schema
    for k in range(5):
        rows = sent.loc[sent["batch"] == k, BARS]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    history = bars.where("symbol = 'b' and rn < 100").withColumn("n", F.lit(100).cast("long"))
    out = running_indicators(source, lateness_seconds=400 * 3600, start=state_after(history))
    sm.run_updates(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    updates = spark.read.parquet(str(tmp_path / "out"))
    assert updates.select("batch_id").distinct().count() == 5
    got = collected(sm.latest(spark, str(tmp_path / "out"), ["symbol", "ts"]), ("symbol", "ts"))
    assert updates.count() > len(got) == len(stream)
    kept = bars.where("symbol = 'c' or symbol = 'b'")
    want = collected(sr.basic_indicators(kept), ("symbol", "ts"))
    ema = collected(sr.smoothed(kept, {"ema": ("close", 2 / 22, 21)}), ("symbol", "ts"))
    inside = ((want["rn"] >= 100) | (want["symbol"] == "c")).to_numpy()
    np.testing.assert_allclose(got["atr"], want["atr"][inside], rtol=1e-9)
    np.testing.assert_allclose(got["rsi"], want["rsi"][inside], rtol=1e-7)
    np.testing.assert_allclose(got["ema"], ema["ema"][inside], rtol=1e-12)


def test_context_over_batches_equals_the_batch(spark, bars, tmp_path):
    some = bars.where("symbol = 'b'")
    stream = stream_in_three(spark, some, str(tmp_path / "in"), BARS)
    sm.run_updates(live_context(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = collected(spark.read.parquet(str(tmp_path / "out")), ("symbol", "ts"))
    want = collected(rs.with_context(some))
    assert len(got) == len(want) == 900
    for name in ("mtf_4h_rsi_14", "mtf_1d_log_return_1", "mtf_4h_adx"):
        np.testing.assert_allclose(got[name], want[name], rtol=1e-7, err_msg=name)


def test_context_of_late_and_repeated_bars_equals_the_batch(spark, bars, tmp_path):
    """Batches hold bars of two symbols out of order, a batch late and twice; the state stays small."""
    rng = np.random.default_rng(8)
    some = collected(bars.where("symbol <> 'a'"), ("symbol", "ts"))
    some["batch"] = (some["rn"] // 200 + rng.integers(0, 2, len(some))).clip(0, 4)
    again = some.sample(frac=0.2, random_state=1).assign(batch=lambda x: (x["batch"] + 1).clip(0, 4))
    sent = pd.concat([some, again]).sample(frac=1.0, random_state=2)
    schema = bars.select(*BARS).schema
    for k in range(5):
        spark.createDataFrame(sent.loc[sent["batch"] == k, BARS], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    sm.run_updates(live_context(source, lateness_seconds=420 * 3600), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = collected(sm.latest(spark, str(tmp_path / "out"), ["symbol", "ts"]), ("symbol", "ts"))
    want = collected(rs.with_context(bars.where("symbol <> 'a'")), ("symbol", "ts"))
    assert len(got) == len(want)
    for name in [c for c in want.columns if c.startswith("mtf_")]:
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), rtol=1e-8, atol=1e-10, err_msg=name)


def test_a_closed_bin_leaves_no_bars_behind():
    """Bars one by one leave the same state as all at once, and what is kept does not grow."""
    frame = walk("x", 900, 3)
    frame["at"] = frame["ts"].astype("int64") // 1000 if frame["ts"].dtype != "datetime64[us]" else frame["ts"].astype("int64")
    bins = coarse(frame, 14_400)
    features, numbers = followed(Bin(), bins)
    state, rows = Bin(), []
    for k in range(len(bins)):
        one = bins.iloc[k : k + 1]
        f, n = followed(state, one)
        rows.append(f[0])
        state = closed_up_to(state, one, f, n, int(one.index[0]))
        assert len(state.closes) <= 19 and len(state.volumes) <= 19
    np.testing.assert_allclose(np.array(rows), features, rtol=1e-10, atol=1e-12)
    np.testing.assert_allclose(state.numbers, numbers[-1], rtol=1e-10)
    assert state.seen == len(bins) and state.last == rows[-1].tolist()


def test_first_seen_keeps_one_per_bar_over_batches(spark, bars, tmp_path):
    some = bars.where("symbol = 'b'").selectExpr("symbol", "cast(ts as timestamp) as ts", "close", "rn")
    doubled = some.unionByName(some.where("rn % 3 = 0"))
    stream = stream_in_three(spark, doubled, str(tmp_path / "in"), ["symbol", "ts", "close"])
    sm.run_updates(sm.first_seen(stream, "2 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 900 == got.select("ts").distinct().count()


def test_stream_bars_equal_batch_bars(spark, bars, tmp_path):
    ticks = bars.where("symbol = 'b'").selectExpr("symbol", "cast(ts as timestamp) as ts", "close", "volume", "rn")
    stream = stream_in_three(spark, ticks, str(tmp_path / "in"), ["symbol", "ts", "close", "volume", "rn"])
    out = sm.stream_bars(stream, "close", "volume", ["ts", "rn"], "1 day", "1 day")
    sm.run_updates(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = collected(sm.latest(spark, str(tmp_path / "out"), ["symbol", "ts"]), ("symbol", "ts"))
    frame = ticks.toPandas().sort_values("ts").set_index("ts").resample("1D")
    np.testing.assert_allclose(got["open"], frame["close"].first())
    np.testing.assert_allclose(got["high"], frame["close"].max())
    np.testing.assert_allclose(got["close"], frame["close"].last())
    np.testing.assert_allclose(got["volume"], frame["volume"].sum())


def test_context_of_sparse_weekly_bars_with_a_late_symbol(spark, tmp_path):
    """Ten years of weekly bars of two symbols in three batches, one symbol behind: nothing is forgotten."""
    from conftest import SCHEMA, walk

    frame = pd.concat([walk("a", 520, 5, "2014-01-05", "7D"), walk("b", 520, 6, "2014-01-05", "7D")], ignore_index=True)
    rows = spark.createDataFrame(frame, SCHEMA)
    parts = ["symbol = 'a' and rn < 300", "symbol = 'b' and rn < 400 or symbol = 'a' and rn between 300 and 419", "rn >= 400 and symbol = 'b' or rn >= 420"]
    for i, part in enumerate(parts):
        rows.where(part).select(*BARS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(rows.select(*BARS).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    sm.run_updates(live_context(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = collected(spark.read.parquet(str(tmp_path / "out")), ("symbol", "ts"))
    want = collected(rs.with_context(rows), ("symbol", "ts"))
    assert len(got) == len(want) == 1040 and got["part"].nunique() == 3
    for name in [c for c in want.columns if c.startswith("mtf_")]:
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), rtol=1e-9, atol=1e-11, err_msg=name)
