"""Step functions of non-linear recurrences and state machines, and the operators that fold them over bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.functions.ordered import fold
from tapewright.operators.volatility import atr


def none(x) -> bool:
    return x is None or x != x


def parabolic_sar(first: float = 0.02, step: float = 0.02, most: float = 0.2):
    """Starts in a downtrend at the first high; turns when the price crosses the stop, which two bars before limit."""

    def f(s, high, low):
        if s is None:
            return (-1, high, low, first, high, high, low, low), (high, -1)
        trend, sar, ep, af, high1, high2, low1, low2 = s
        sar += af * (ep - sar)
        if trend > 0:
            sar = min(sar, low1, low2)
            if low < sar:
                trend, sar, ep, af = -1, ep, low, first
            elif high > ep:
                ep, af = high, min(af + step, most)
        else:
            sar = max(sar, high1, high2)
            if high > sar:
                trend, sar, ep, af = 1, ep, high, first
            elif low < ep:
                ep, af = low, min(af + step, most)
        return (trend, sar, ep, af, high, high1, low, low1), (sar, trend)

    return f


def adaptive(seed: int):
    """y += c (x - y) with a coefficient per row; starts with x where row number `seed` is reached."""

    def f(s, x, c):
        k, y = (0, None) if s is None else s
        if k == seed:
            y = x
        elif y is not None and not none(c):
            y += c * (x - y)
        return (k + 1, y), (y,)

    return f


def mcginley(n: int):
    def f(y, x):
        if not none(x):
            y = x if y is None else y + (x - y) / (n * (x / y) ** 4)
        return y, (y,)

    return f


def zscore_positions(enter: float = 2.0, leave: float = 0.5, stop: float = 3.0):
    """Short above `enter`, long below it, flat inside `leave` or beyond `stop`."""

    def f(p, z):
        p = p or 0
        if none(z):
            return p, (p,)
        if p == 0:
            p = -1 if enter < z < stop else 1 if -stop < z < -enter else 0
        elif abs(z) < leave or abs(z) > stop or p * z > 0:
            p = 0
        return p, (p,)

    return f


def holding(n: int):
    """A signal may change only n bars after its last change."""

    def f(s, x):
        if s is None:
            return (x, 0), (x,)
        held, age = s
        held, age = (x, 0) if x != held and age + 1 >= n else (held, age + 1)
        return (held, age), (held,)

    return f


def drawdown_scale(reduce: float = 0.1, close: float = 0.2, resume: float = 0.05):
    """Exposure 1, 0.5 or 0 by the fall from the peak; it comes back once the fall is under `resume`."""

    def f(s, x):
        peak, scale = (x, 1.0) if s is None else s
        peak = max(peak, x)
        fall = 1 - x / peak
        scale = 0.0 if fall >= close else min(scale, 0.5) if fall >= reduce else 1.0 if fall < resume else scale
        return (peak, scale), (scale,)

    return f


def breakout(stop: float = 1.5, profit: float = 3.0, trail: float = 1.0, least_atr: float = 0.001):
    """Long over the upper band and short under the lower with volume; out at a stop, at a trailing stop from the best price since entry, or at a profit, all in true ranges of the entry."""

    def f(s, ready, close, high, low, upper, lower, confirmed, atr):
        p, entry, unit, best = s or (0, 0.0, 0.0, 0.0)
        if not ready:
            return (p, entry, unit, best), (0,)
        if none(atr) or atr < least_atr:
            return (p, entry, unit, best), (p,)
        if p == 0:
            p = (1 if close > upper else -1 if close < lower else 0) if confirmed else 0
            if p:
                entry, unit, best = close, atr, high if p > 0 else low
        else:
            best = max(best, high) if p > 0 else min(best, low)
            gained = (close - entry) * p
            if gained < -stop * unit or (close - best) * p < -trail * unit or gained > profit * unit:
                p = 0
        return (p, entry, unit, best), (p,)

    return f


def sar(df: DataFrame) -> DataFrame:
    return fold(df, ["high", "low"], parabolic_sar(), {"sar": "double", "sar_trend": "int"})


def kama(df: DataFrame, n: int = 10, fast: int = 2, slow: int = 30) -> DataFrame:
    """Efficiency ratio by windows, then the recurrence."""
    df = df.withColumn("_d", F.abs(R.change("close")))
    er = F.coalesce(F.try_divide(F.abs(R.change("close", n)), R.total("_d", n)), F.lit(0.0))
    a, b = 2 / (fast + 1), 2 / (slow + 1)
    return fold(df.withColumn("_c", F.pow(er * (a - b) + b, F.lit(2))), ["close", "_c"], adaptive(n - 1), {f"kama_{n}": "double"})


def frama(df: DataFrame, n: int = 16) -> DataFrame:
    """Alpha from the fractal dimension of the n bars before the current one."""
    h = n // 2
    w = lambda a, b: R.W.rowsBetween(a, b)
    span = lambda a, b, k: (F.max("high").over(w(a, b)) - F.min("low").over(w(a, b))) / k
    n1, n2, n3 = span(-n, -h - 1, h), span(-h, -1, h), span(-n, -1, n)
    d = F.when((n1 > 0) & (n2 > 0) & (n3 > 0), (F.ln(n1 + n2) - F.ln(n3)) / math.log(2))
    a = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.exp(-4.6 * (d - 1))))
    enough = F.count("close").over(w(-n, -1)) == n
    return fold(df.withColumn("_c", F.when(enough, F.coalesce(a, F.lit(1.0)))), ["close", "_c"], adaptive(n - 1), {f"frama_{n}": "double"})


def vidya(df: DataFrame, n: int = 14, cmo: int = 9) -> DataFrame:
    d = R.change("close")
    df = df.withColumns({"_u": F.greatest(d, d * 0), "_v": F.greatest(-d, d * 0)})
    up, down = R.total("_u", cmo), R.total("_v", cmo)
    c = F.abs(F.coalesce(F.try_divide(up - down, up + down), F.lit(0.0))) * (2 / (n + 1))
    return fold(df.withColumn("_c", c), ["close", "_c"], adaptive(0), {f"vidya_{n}": "double"})


def mcginley_dynamic(df: DataFrame, n: int = 14) -> DataFrame:
    """Of the 20-bar mean: prices that jump by multiples make the recurrence explode."""
    return fold(df.withColumn("_m", R.mean("close", 20)), ["_m"], mcginley(n), {f"mcginley_{n}": "double"})


def mean_reversion(df: DataFrame, n: int = 20) -> DataFrame:
    z = F.round(R.zscore("close", n), 9)
    return fold(df.withColumn("_z", z), ["_z"], zscore_positions(), {"position": "int"})


def minimum_holding(df: DataFrame, n: int = 5) -> DataFrame:
    s = F.coalesce(F.signum(R.change("close")), F.lit(0.0))
    return fold(df.withColumn("_s", s), ["_s"], holding(n), {"held_signal": "double"})


def drawdown_control(df: DataFrame) -> DataFrame:
    return fold(df, ["close"], drawdown_scale(), {"exposure": "double"})


def band_breakout(df: DataFrame, n: int = 14, k: float = 2.0, lookback: int = 20, volume: float = 1.5) -> DataFrame:
    """Positions at the close before plus or minus k true ranges, where volume is over its mean; the first `lookback` rows have none."""
    df = atr(df, n).withColumns({"_a": F.round(f"atr_{n}", 9), "_k": F.row_number().over(R.W), "_v": R.mean("volume", lookback), "_p": R.lag("close")})
    df = df.withColumns({"_ready": F.col("_k") > lookback, "_u": F.col("_p") + k * F.col("_a"), "_l": F.col("_p") - k * F.col("_a"), "_c": F.coalesce(F.col("volume") > volume * F.col("_v"), F.lit(False))})
    return fold(df, ["_ready", "close", "high", "low", "_u", "_l", "_c", "_a"], breakout(), {"position": "int"})
