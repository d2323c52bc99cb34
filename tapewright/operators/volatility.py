"""Volatility, bands and volume indicators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.functions.ema import alpha, ema

BARS_PER_YEAR = 252 * 26


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, eps: float = 0.0) -> DataFrame:
    df = df.withColumns({"bb_middle": R.mean("close", n), "_sd": R.std("close", n)})
    df = df.withColumns({"bb_upper": F.col("bb_middle") + k * F.col("_sd"), "bb_lower": F.col("bb_middle") - k * F.col("_sd")})
    width = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumns({"bb_width": 100 * F.try_divide(width, F.col("bb_middle") + eps), "bb_pct": F.try_divide(F.col("close") - F.col("bb_lower"), width + eps)}).drop("_sd")


def atr(df: DataFrame, n: int = 14, adjust: bool = False) -> DataFrame:
    return ema(df.withColumn("_tr", R.true_range()), {f"atr_{n}": ("_tr", alpha(n))}, adjust=adjust).drop("_tr")


def keltner(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    df = ema(df.withColumn("_tr", R.true_range()), {"_atr": ("_tr", alpha(n)), "kc_middle": ("close", alpha(n))})
    return df.withColumns({"kc_upper": F.col("kc_middle") + k * F.col("_atr"), "kc_lower": F.col("kc_middle") - k * F.col("_atr")}).drop("_tr", "_atr")


def donchian(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumns({"dc_upper": R.highest("high", n), "dc_lower": R.lowest("low", n)})
    return df.withColumn("dc_middle", (F.col("dc_upper") + F.col("dc_lower")) / 2)


def historical(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumn("_r", F.ln(F.col("close")) - F.ln(R.lag("close")))
    return df.withColumn(f"hist_vol_{n}", R.std("_r", n) * math.sqrt(BARS_PER_YEAR)).drop("_r")


def range_based(df: DataFrame, n: int = 20) -> DataFrame:
    """Garman-Klass, Parkinson and Yang-Zhang."""
    hl, co = R.log(R.quotient("high", "low")), R.log(R.quotient("close", "open"))
    ho, lo = R.log(R.quotient("high", "open")), R.log(R.quotient("low", "open"))
    df = df.withColumns(
        {
            "_gk": 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co, "_pk": hl * hl / (4 * math.log(2)), "_on": R.log("open") - R.log(R.lag("close")),
            "_co": co, "_rs": ho * (ho - co) + lo * (lo - co),
        }
    )
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    yz = R.roll(F.var_samp, "_on", n) + k * R.roll(F.var_samp, "_co", n) + (1 - k) * R.mean("_rs", n)
    year = math.sqrt(BARS_PER_YEAR)
    root = lambda x: F.when(x >= 0, F.sqrt(x)) * year
    return df.withColumns({f"garman_klass_{n}": root(R.mean("_gk", n)), f"parkinson_{n}": root(R.mean("_pk", n)), f"yang_zhang_{n}": root(yz)}).drop("_gk", "_pk", "_on", "_co", "_rs")


def realised(df: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    df = df.withColumn("_r", R.pct("close"))
    return df.withColumns({f"volatility_{n}": R.std("_r", n) for n in windows}).drop("_r")


def obv(df: DataFrame) -> DataFrame:
    d = R.change("close")
    df = df.withColumn("_s", F.signum(d) * F.col("volume"))
    return df.withColumn("obv", F.when(F.col("_s").isNotNull(), R.running(F.sum, "_s"))).drop("_s")


def cumulative_vwap(df: DataFrame) -> DataFrame:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    return df.withColumn("vwap_running", F.try_divide(R.running(F.sum, tp * F.col("volume")), R.running(F.sum, "volume")))


def mfi(df: DataFrame, n: int = 14) -> DataFrame:
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    flow, d = F.col("_tp") * F.col("volume"), R.change("_tp")
    df = df.withColumns({"_up": F.when(d > 0, flow).otherwise(0.0), "_down": F.when(d < 0, flow).otherwise(0.0)})
    up, down = R.total("_up", n), R.total("_down", n)
    return df.withColumn(f"mfi_{n}", 100 * F.try_divide(up, up + down)).drop("_tp", "_up", "_down")


def flow(df: DataFrame, n: int = 20) -> DataFrame:
    """Accumulation/distribution and Chaikin money flow; a flat bar moves nothing."""
    c, h, lo = F.col("close"), F.col("high"), F.col("low")
    df = df.withColumn("_mfv", F.coalesce(F.try_divide((c - lo) - (h - c), h - lo), F.lit(0.0)) * F.col("volume"))
    df = df.withColumns({"ad_line": R.running(F.sum, "_mfv"), f"cmf_{n}": F.try_divide(R.total("_mfv", n), R.total("volume", n))})
    return df.drop("_mfv")


def volume_change(df: DataFrame, n: int = 10) -> DataFrame:
    return df.withColumn(f"volume_roc_{n}", 100 * R.pct("volume", n))


def force_index(df: DataFrame, n: int = 13) -> DataFrame:
    return ema(df.withColumn("_f", R.change("close") * F.col("volume")), {f"force_index_{n}": ("_f", alpha(n))}).drop("_f")


def ease_of_movement(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean of n moves of the middle, each per volume over range; a traded bar without range counts as 0."""
    df = df.withColumn("_mid", (F.col("high") + F.col("low")) / 2)
    box = F.try_divide(F.col("volume"), F.col("high") - F.col("low"))
    moved = F.when((F.col("high") == F.col("low")) & (F.col("volume") > 0), R.change("_mid") * 0).otherwise(F.try_divide(R.change("_mid"), box))
    return df.withColumn("_e", moved).withColumn(f"eom_{n}", R.mean("_e", n)).drop("_mid", "_e")


def volume_features(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumn("volume_ma", R.mean("volume", n))
    return df.withColumns({"volume_ratio": F.col("volume") / (F.col("volume_ma") + 1), "volume_confirmed": F.when(F.col("volume") > 1.5 * F.col("volume_ma"), 1).otherwise(0)})
