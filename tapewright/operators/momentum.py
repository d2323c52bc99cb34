"""Momentum indicators and oscillators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.functions.ema import alpha, ema


def _gains(df: DataFrame, first_zero: bool) -> DataFrame:
    d = R.change("close")
    d = F.coalesce(d, F.lit(0.0)) if first_zero else d
    return df.withColumns({"_gain": F.greatest(d, d * 0), "_loss": F.greatest(-d, d * 0)})


def rsi(df: DataFrame, n: int = 14, method: str = "ema") -> DataFrame:
    """method: ema (span), adjusted (normalised weights, loss at least 1e-10) or mean (rolling)."""
    df = _gains(df, method == "ema")
    if method == "mean":
        df = df.withColumns({"_g": R.mean("_gain", n), "_l": R.mean("_loss", n)})
    else:
        df = ema(df, {"_g": ("_gain", alpha(n)), "_l": ("_loss", alpha(n))}, adjust=method == "adjusted")
    g, loss = F.col("_g"), F.col("_l")
    if method == "adjusted":
        value = 100 - 100 / (1 + g / F.when(loss == 0, 1e-10).otherwise(loss))
    else:
        value = F.when((loss == 0) & (g > 0), 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(g, loss)))
    return df.withColumn(f"rsi_{n}", value).drop("_gain", "_loss", "_g", "_l")


def stochastic(df: DataFrame, n: int = 14, smooth: int = 3, d: int = 3) -> DataFrame:
    low, high = R.lowest("low", n), R.highest("high", n)
    df = df.withColumn("_k", 100 * F.try_divide(F.col("close") - low, high - low))
    df = df.withColumn("stoch_k", R.mean("_k", smooth))
    return df.withColumn("stoch_d", R.mean("stoch_k", d)).drop("_k")


def williams(df: DataFrame, n: int = 14) -> DataFrame:
    low, high = R.lowest("low", n), R.highest("high", n)
    return df.withColumn(f"williams_r_{n}", -100 * F.try_divide(high - F.col("close"), high - low))


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    """Deviation of the typical price from its mean over the mean absolute deviation of the window."""
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    values = F.when(F.count("_tp").over(R.W.rowsBetween(-(n - 1), 0)) == n, F.collect_list("_tp").over(R.W.rowsBetween(-(n - 1), 0)))
    df = df.withColumns({"_ma": R.mean("_tp", n), "_all": values})
    mad = F.aggregate(F.transform("_all", lambda x: F.abs(x - F.col("_ma"))), F.lit(0.0), lambda s, x: s + x) / n
    return df.withColumn(f"cci_{n}", F.try_divide(F.col("_tp") - F.col("_ma"), 0.015 * mad)).drop("_tp", "_ma", "_all")


def roc(df: DataFrame, n: int = 10) -> DataFrame:
    return df.withColumns({f"roc_{n}": 100 * R.pct("close", n), f"momentum_{n}": R.change("close", n)})


def tsi(df: DataFrame, long: int = 25, short: int = 13) -> DataFrame:
    df = df.withColumn("_d", R.change("close"))
    df = ema(df.withColumn("_a", F.abs("_d")), {"_d1": ("_d", alpha(long)), "_a1": ("_a", alpha(long))})
    df = ema(df, {"_d2": ("_d1", alpha(short)), "_a2": ("_a1", alpha(short))})
    return df.withColumn("tsi", 100 * R.ratio("_d2", "_a2")).drop("_d", "_a", "_d1", "_a1", "_d2", "_a2")


def ultimate(df: DataFrame, n: tuple[int, int, int] = (7, 14, 28)) -> DataFrame:
    prev = R.lag("close")
    low = F.least("low", prev)
    df = df.withColumns({"_bp": F.col("close") - low, "_tr": F.greatest("high", prev) - low})
    a, b, c = (F.try_divide(R.total("_bp", k), R.total("_tr", k)) for k in n)
    return df.withColumn("ultimate", 100 * (4 * a + 2 * b + c) / 7).drop("_bp", "_tr")


def returns(df: DataFrame, periods: tuple[int, ...] = (1, 5, 10, 20, 60), log: bool = False) -> DataFrame:
    one = lambda k: R.log("close") - R.log(R.lag("close", k)) if log else R.pct("close", k)
    return df.withColumns({f"{'log_' if log else ''}return_{k}": one(k) for k in periods})


def lags(df: DataFrame, periods: tuple[int, ...] = (1, 2, 5, 10), x: str = "close") -> DataFrame:
    return df.withColumns({f"{x}_lag_{k}": R.lag(x, k) for k in periods} | {f"{x}_change_{k}": R.change(x, k) for k in periods})
