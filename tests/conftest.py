import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("barloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.cache.maxEntries", "4000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def walk(symbol: str, n: int, seed: int, start="2024-01-01", step="1h") -> pd.DataFrame:
    """Random-walk bars with some bars that have no range."""
    rng = np.random.default_rng(seed)
    close = 1000.0 + np.cumsum(rng.normal(0.0, 1.0, n))
    open_ = np.concatenate([[1000.0], close[:-1]])
    flat = rng.random(n) < 0.05
    close = np.where(flat, open_, close)
    top, bottom = np.maximum(open_, close), np.minimum(open_, close)
    high = np.where(flat, top, top + rng.random(n))
    low = np.where(flat, bottom, bottom - rng.random(n))
    return pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.date_range(start, periods=n, freq=step),
            "open": open_,
            "high": high,
            "low": low,
            "close": close,
            "volume": np.round(rng.random(n) * 100, 2),
            "rn": np.arange(n, dtype="int64"),
            "n": np.int64(n),
        }
    )


SCHEMA = (
    "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, "
    "rn bigint, n bigint"
)


@pytest.fixture(scope="session")
def bars_frame():
    return pd.concat([walk("a", 7000, 1), walk("b", 900, 2), walk("c", 15, 3)], ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, bars_frame):
    return spark.createDataFrame(bars_frame, SCHEMA).repartition(8).cache()


def collected(df, order=("symbol", "rn")) -> pd.DataFrame:
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)
