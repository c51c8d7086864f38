"""barloom: candle (OHLCV) time-series analytics written as Spark DataFrame operators."""

__version__ = "0.1.0"
