"""Moving averages and trend indicators. Each function adds columns named <indicator>_<period>."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.functions.ema import alpha, ema


def sma(df: DataFrame, n: int = 20, x: str = "close") -> DataFrame:
    return df.withColumn(f"sma_{n}", R.mean(x, n))


def ema_of(df: DataFrame, n: int = 12, x: str = "close", adjust: bool = False) -> DataFrame:
    return ema(df, {f"ema_{n}": (x, alpha(n))}, adjust=adjust)


def weighted(x: str, weights: list[float]) -> Column:
    """Fixed-weight moving sum, weights from the oldest row to the current; null until all rows are there."""
    n = len(weights)
    terms = [F.lit(w) * (F.col(x) if k == n - 1 else R.lag(x, n - 1 - k)) for k, w in enumerate(weights)]
    return sum(terms[1:], terms[0])


def wma(df: DataFrame, n: int = 20, x: str = "close") -> DataFrame:
    whole = n * (n + 1) / 2
    return df.withColumn(f"wma_{n}", weighted(x, [(k + 1) / whole for k in range(n)]))


def alma(df: DataFrame, n: int = 20, offset: float = 0.85, sigma: float = 6.0, x: str = "close") -> DataFrame:
    m, s = offset * (n - 1), n / sigma
    raw = [math.exp(-((k - m) ** 2) / (2 * s * s)) for k in range(n)]
    return df.withColumn(f"alma_{n}", weighted(x, [w / sum(raw) for w in raw]))


def multi_ema(df: DataFrame, n: int = 20, x: str = "close") -> DataFrame:
    """DEMA and TEMA."""
    a = alpha(n)
    df = ema(df, {"_e1": (x, a)})
    df = ema(df, {"_e2": ("_e1", a)})
    df = ema(df, {"_e3": ("_e2", a)})
    e1, e2, e3 = F.col("_e1"), F.col("_e2"), F.col("_e3")
    return df.withColumns({f"dema_{n}": 2 * e1 - e2, f"tema_{n}": 3 * e1 - 3 * e2 + e3}).drop("_e1", "_e2", "_e3")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, x: str = "close") -> DataFrame:
    df = ema(df, {"_fast": (x, alpha(fast)), "_slow": (x, alpha(slow))})
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow"))
    df = ema(df, {"macd_signal": ("macd", alpha(signal))})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """ADX with +DI and -DI from exponential averages."""
    up, down = R.change("high"), -R.change("low")
    df = df.withColumns(
        {
            "_tr": R.true_range(),
            "_plus": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
        }
    )
    a = alpha(n)
    df = ema(df, {"_atr": ("_tr", a), "_p": ("_plus", a), "_m": ("_minus", a)})
    df = df.withColumns({f"plus_di_{n}": 100 * R.ratio("_p", "_atr"), f"minus_di_{n}": 100 * R.ratio("_m", "_atr")})
    p, m = F.col(f"plus_di_{n}"), F.col(f"minus_di_{n}")
    df = df.withColumn("_dx", F.coalesce(100 * F.try_divide(F.abs(p - m), p + m), F.lit(0.0)))
    return ema(df, {f"adx_{n}": ("_dx", a)}).drop("_tr", "_plus", "_minus", "_atr", "_p", "_m", "_dx")


def ichimoku(df: DataFrame, conversion: int = 9, base: int = 26, span: int = 52, chikou: bool = False) -> DataFrame:
    """Lines and spans, the spans as they stand at the bar; the chikou line looks ahead and is off by default."""
    mid = lambda n: (R.highest("high", n) + R.lowest("low", n)) / 2
    df = df.withColumns({"tenkan": mid(conversion), "kijun": mid(base), "_b": mid(span)})
    df = df.withColumn("_a", (F.col("tenkan") + F.col("kijun")) / 2)
    df = df.withColumns({"span_a": R.lag("_a", base), "span_b": R.lag("_b", base)}).drop("_a", "_b")
    return df.withColumn("chikou", R.lead("close", base)) if chikou else df


def adaptive_atr(df: DataFrame, n: int = 14, fast: int = 5, slow: int = 50) -> DataFrame:
    """ATR between a fast and a slow average of true range, by the efficiency ratio."""
    df = df.withColumn("_tr", R.true_range())
    df = df.withColumn("_d", F.abs(R.change("close")))
    er = F.coalesce(F.try_divide(F.abs(R.change("close", n)), R.total("_d", n)), F.lit(0.0))
    df = ema(df.withColumn("_er", er), {"_f": ("_tr", alpha(fast)), "_s": ("_tr", alpha(slow))})
    return df.withColumn("adaptive_atr", F.col("_er") * F.col("_f") + (1 - F.col("_er")) * F.col("_s")).drop("_tr", "_d", "_er", "_f", "_s")


def technical(df: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 50, 100, 200)) -> DataFrame:
    """Price to average ratios and crosses of all periods in one projection over shared windows."""
    out = {f"sma_{n}": R.mean("close", n) for n in periods}
    df = df.withColumns(out)
    df = df.withColumns({f"close_to_sma_{n}": R.ratio("close", f"sma_{n}") - 1 for n in periods})
    return df.withColumns({f"sma_cross_{a}_{b}": F.when(F.col(f"sma_{a}") > F.col(f"sma_{b}"), 1).otherwise(0) for a, b in zip(periods, periods[1:])})


def multi_timeframe(base: DataFrame, higher: dict[str, DataFrame], n: int = 10) -> DataFrame:
    """Trend flags of higher timeframes, as known when each base bar begins: only completed bars count.

    higher: interval such as '1 hour' -> its bars. An as-of join by union and last value: one sort.
    """
    out = base
    for every, bars in higher.items():
        name = every.replace(" ", "_")
        own = bars.withColumn("_t", F.when(F.col("close") > R.mean("close", n), 1).when(R.mean("close", n).isNotNull(), 0))
        ready = own.select("symbol", (F.col("ts") + F.expr(f"interval {every}")).alias("ts"), F.struct("_t").alias("_v"), F.lit(0).alias("_side"))
        both = out.withColumns({"_v": F.lit(None).cast("struct<_t:int>"), "_side": F.lit(1)}).unionByName(ready, allowMissingColumns=True)
        w = Window.partitionBy("symbol").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn(f"trend_{name}", F.last("_v", ignorenulls=True).over(w)["_t"]).where("_side = 1").drop("_v", "_side")
    flags = [f"trend_{e.replace(' ', '_')}" for e in higher]
    known = [F.col(f).isNotNull() for f in flags]
    everywhere = known[0]
    for k in known[1:]:
        everywhere = everywhere & k
    votes = sum((F.coalesce(F.col(f), F.lit(0)) for f in flags[1:]), F.coalesce(F.col(flags[0]), F.lit(0)))
    return out.withColumns({"trend_votes": votes, "trend_unanimous": F.when(everywhere & ((votes == 0) | (votes == len(flags))), 1).otherwise(0)})
