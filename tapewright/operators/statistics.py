"""Rolling statistics, regimes, breaks and labels of one series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R


def moments(df: DataFrame, n: int = 20) -> DataFrame:
    """Bias-corrected skew and excess kurtosis of returns, as pandas has them."""
    df = df.withColumn("_r", R.pct("close"))
    g1, g2 = R.roll(F.skewness, "_r", n), R.roll(F.kurtosis, "_r", n)
    df = df.withColumns({f"skew_{n}": g1 * math.sqrt(n * (n - 1)) / (n - 2), f"kurt_{n}": ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))})
    return df.drop("_r")


def zscores(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumns({f"price_z_{n}": R.zscore("close", n), f"volume_z_{n}": R.zscore("volume", n)})


def autocorrelation(df: DataFrame, n: int = 50, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Correlation of returns with their lags inside a window of n."""
    df = df.withColumn("_r", R.pct("close"))
    df = df.withColumns({f"_r{k}": R.lag("_r", k) for k in ks})
    out = {}
    for k in ks:
        w = R.W.rowsBetween(-(n - k - 1), 0)
        x, y = F.col("_r"), F.col(f"_r{k}")
        sd = F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)
        out[f"autocorr_{k}"] = F.when(F.count(y).over(w) >= n - k, F.try_divide(F.covar_pop(x, y).over(w), sd))
    return df.withColumns(out).drop("_r", *[f"_r{k}" for k in ks])


def hurst(df: DataFrame, n: int = 100) -> DataFrame:
    """Single-scale rescaled range of the last n returns: ln(R/S) / ln(n)."""
    df = df.withColumn("_r", R.pct("close"))
    w = R.W.rowsBetween(-(n - 1), 0)
    df = df.withColumns({"_v": F.when(F.count("_r").over(w) == n, F.collect_list("_r").over(w)), "_m": F.avg("_r").over(w), "_s": F.stddev_pop("_r").over(w)})
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

    def step(a, x):
        c = a["c"] + x - F.col("_m")
        return F.struct(c.alias("c"), F.least(a["lo"], c).alias("lo"), F.greatest(a["hi"], c).alias("hi"))

    spread = F.aggregate("_v", start, step, lambda a: a["hi"] - a["lo"])
    rs = F.try_divide(spread, F.col("_s"))
    return df.withColumn(f"hurst_{n}", F.when(rs > 0, F.ln(rs) / math.log(n))).drop("_r", "_v", "_m", "_s")


def market_beta(df: DataFrame, n: int = 60) -> DataFrame:
    """Rolling correlation with, and beta to, the equal-weight mean return of all symbols."""
    df = df.withColumn("_r", R.pct("close"))
    df = df.withColumn("_m", F.avg("_r").over(Window.partitionBy("ts")))
    df = df.withColumn("_m", F.when(F.col("_r").isNotNull(), F.col("_m")))
    w = R.W.rowsBetween(-(n - 1), 0)
    cov, vm, vr = F.covar_samp("_r", "_m").over(w), F.var_samp("_m").over(w), F.var_samp("_r").over(w)
    enough = F.count("_r").over(w) == n
    return df.withColumns({f"market_corr_{n}": F.when(enough, F.try_divide(cov, F.sqrt(vm * vr))), f"market_beta_{n}": F.when(enough, F.try_divide(cov, vm))}).drop("_r", "_m")


def fractional_weights(d: float, cut: float = 1e-5, most: int = 1000) -> list[float]:
    w = [1.0]
    while len(w) < most:
        x = -w[-1] * (d - len(w) + 1) / len(w)
        if abs(x) < cut:
            break
        w.append(x)
    return w


def fractional_difference(df: DataFrame, d: float = 0.8, cut: float = 1e-3, expanding: bool = False) -> DataFrame:
    """Fixed-weight moving sum with the binomial weights of (1 - B)^d; expanding also serves the first rows."""
    w = fractional_weights(d, cut)
    n = len(w)
    frame = R.W.rowsBetween(-(n - 1), 0)
    values = F.reverse(F.collect_list("close").over(frame))
    s = F.aggregate(F.zip_with(values, F.array(*map(F.lit, w)), lambda x, k: F.coalesce(x * k, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    return df.withColumn("frac_diff", s if expanding else F.when(F.count("close").over(frame) == n, s))


def percentile_regime(df: DataFrame, n: int = 20, window: int = 252, least: int = 20) -> DataFrame:
    """Share of the window's volatilities strictly below the current one, and its label."""
    df = df.withColumn("_r", R.pct("close"))
    df = df.withColumn("_v", F.round(R.std("_r", n), 12))
    w = R.W.rowsBetween(-(window - 1), 0)
    below = F.size(F.filter(F.collect_list("_v").over(w), lambda x: x < F.col("_v")))
    pct = F.when(F.col("_v").isNotNull() & (F.count("_v").over(w) >= least), 100.0 * below / F.count("_v").over(w))
    df = df.withColumn("vol_percentile", pct)
    p = F.col("vol_percentile")
    label = F.when(p < 10, "very_low").when(p < 25, "low").when(p < 75, "normal").when(p < 90, "high").when(p.isNotNull(), "extreme")
    return df.withColumn("vol_regime", label).drop("_r", "_v")


def trend_regime(df: DataFrame, n: int = 14, fast: int = 20, slow: int = 50, strong: float = 25.0) -> DataFrame:
    """ADX from rolling means over a threshold with the averages' order: 2 up, 0 down, 1 neither."""
    up, down = R.change("high"), -R.change("low")
    df = df.withColumns({"_tr": R.true_range(), "_p": F.when((up > down) & (up > 0), up).otherwise(0.0), "_m": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    tr, p, m = R.mean("_tr", n), R.mean("_p", n), R.mean("_m", n)
    df = df.withColumns({"_pd": 100 * F.try_divide(p, tr), "_md": 100 * F.try_divide(m, tr)})
    df = df.withColumn("_dx", 100 * F.try_divide(F.abs(F.col("_pd") - F.col("_md")), F.col("_pd") + F.col("_md")))
    df = df.withColumn("adx_mean", F.coalesce(R.mean("_dx", n), F.lit(0.0)))
    f, s = R.mean("close", fast), R.mean("close", slow)
    df = df.withColumn("trend_regime", F.when((F.col("adx_mean") > strong) & (f > s), 2).when((F.col("adx_mean") > strong) & (f < s), 0).otherwise(1))
    return df.drop("_tr", "_p", "_m", "_pd", "_md", "_dx")


def regime_runs(df: DataFrame, regime: str) -> DataFrame:
    """Whether the regime just changed, and bars since it did."""
    df = df.withColumn("_run", R.islands(regime))
    w = Window.partitionBy("symbol", "_run").orderBy("ts")
    df = df.withColumn("bars_in_regime", F.row_number().over(w))
    return df.withColumn("regime_changed", F.when((F.col("bars_in_regime") == 1) & (F.col("_run") > 0), 1).otherwise(0)).drop("_run")


def cusum(df: DataFrame, a: float = 1.36) -> DataFrame:
    """Standardised cumulative sum of the whole series with its bound, and whether the bound is crossed."""
    whole = Window.partitionBy("symbol")
    df = df.withColumns({"_r": R.pct("close")}).where("_r is not null")
    n = F.count("_r").over(whole)
    df = df.withColumns({"_n": n, "_z": F.try_divide(F.col("_r") - F.avg("_r").over(whole), F.stddev_pop("_r").over(whole)), "_t": F.row_number().over(R.W)})
    df = df.withColumns({"cusum": R.running(F.sum, "_z") / F.sqrt("_n"), "cusum_bound": a * F.sqrt(F.col("_t") / F.col("_n"))})
    return df.withColumn("crossed", F.when(F.abs("cusum") > F.col("cusum_bound"), 1).otherwise(0)).drop("_r", "_n", "_z", "_t")


def recursive_cusum(df: DataFrame, least: int = 20) -> DataFrame:
    """Returns standardised by the moments of the rows before them, summed."""
    df = df.withColumn("_r", R.pct("close"))
    past = R.W.rowsBetween(Window.unboundedPreceding, -1)
    z = F.when(F.count("_r").over(past) >= least, F.try_divide(F.col("_r") - F.avg("_r").over(past), F.stddev_pop("_r").over(past)))
    df = df.withColumn("_z", z)
    return df.withColumn("cusum_recursive", F.when(F.col("_z").isNotNull(), R.running(F.sum, "_z") / F.sqrt(R.running(F.count, "_z")))).drop("_r", "_z")


def wald_breaks(df: DataFrame, trim: float = 0.15) -> DataFrame:
    """Statistic of a shift in the mean return after each row of the trimmed range, from prefix sums."""
    whole = Window.partitionBy("symbol")
    df = df.withColumn("_r", R.pct("close")).where("_r is not null")
    df = df.withColumns({"_n": F.count("_r").over(whole), "_s": F.sum("_r").over(whole), "_q": F.sum(F.col("_r") * F.col("_r")).over(whole)})
    df = df.withColumns({"_k": F.row_number().over(R.W), "_a": R.running(F.sum, "_r"), "_b": R.running(F.sum, F.col("_r") * F.col("_r"))})
    n, k = F.col("_n"), F.col("_k")
    m1, m2 = F.col("_a") / k, F.try_divide(F.col("_s") - F.col("_a"), n - k)
    v1, v2 = F.col("_b") / k - m1 * m1, F.try_divide(F.col("_q") - F.col("_b"), n - k) - m2 * m2
    inside = (k >= F.floor(n * trim)) & (k <= n - F.floor(n * trim)) & (k > 1)
    return df.withColumn("wald", F.when(inside, F.try_divide((m1 - m2) * (m1 - m2), v1 / k + F.try_divide(v2, n - k)))).withColumnRenamed("_r", "r").drop("_n", "_s", "_q", "_k", "_a", "_b")


def market_regime(df: DataFrame, n: int = 20, trend: int = 50, crisis: float = -0.2) -> DataFrame:
    """By rules, in this order: crisis (drawdown), high or low volatility (rank in the series), bull or bear."""
    df = df.withColumn("_r", R.pct("close"))
    df = df.withColumn("_v", F.round(R.std("_r", n), 12))
    rank = F.try_divide(R.average_rank("_v", "symbol"), F.count("_v").over(Window.partitionBy("symbol")))
    df = df.withColumns({"_p": rank, "_ma": R.mean("close", trend), "_dd": F.col("close") / R.running(F.max, "close") - 1})
    kind = F.when(F.col("_dd") < crisis, "crisis").when(F.col("_p") > 0.8, "high_volatility").when(F.col("_p") < 0.2, "low_volatility")
    kind = kind.when(F.col("close") > F.col("_ma"), "bull").when(F.col("close") < F.col("_ma"), "bear").otherwise("neutral")
    return df.withColumn("market_regime", kind).drop("_r", "_v", "_p", "_ma", "_dd")


def periods(df: DataFrame, regime: str) -> DataFrame:
    """Contiguous spans of one regime."""
    runs = df.withColumn("_run", R.islands(regime))
    return runs.groupBy("symbol", "_run").agg(F.first(regime).alias("regime"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_bars")).drop("_run")


def drawdown(df: DataFrame, x: str = "close") -> DataFrame:
    df = df.withColumn("peak", R.running(F.max, x))
    df = df.withColumn("drawdown", F.col(x) / F.col("peak") - 1)
    return df.withColumn("underwater", F.when(F.col("drawdown") < 0, 1).otherwise(0))


def drawdown_events(df: DataFrame, least: float = 0.02, x: str = "close") -> DataFrame:
    """One row per span below a peak that fell by more than `least`: start at the first breach, end at recovery."""
    df = drawdown(df, x).withColumn("_run", R.islands("underwater"))
    end = F.lead("ts").over(R.W)
    df = df.withColumn("_next", end).where("underwater = 1")
    events = df.groupBy("symbol", "_run").agg(
        F.min("drawdown").alias("depth"), F.min(F.when(F.col("drawdown") < -least, F.col("ts"))).alias("start_ts"), F.min_by("ts", F.struct("drawdown", "ts")).alias("trough_ts"),
        F.max_by("_next", "ts").alias("end_ts"), F.count(F.lit(1)).alias("n_bars"),
    )
    return events.where(F.col("depth") < -least).drop("_run")


def triple_barrier(df: DataFrame, horizon: int = 10, width: float = 2.0, n: int = 20) -> DataFrame:
    """First touch of close * (1 +- width * volatility) within the horizon: 1, -1, else the sign of the last return."""
    df = df.withColumn("_r", R.pct("close"))
    df = df.withColumn("_vol", R.std("_r", n))
    ahead = R.W.rowsBetween(1, horizon)
    df = df.withColumn("_next", F.when(F.count("close").over(ahead) == horizon, F.collect_list("close").over(ahead)))
    rel = F.transform("_next", lambda x: R.quotient(x, "close") - 1)
    hit = F.filter(F.transform(rel, lambda x: F.when(x >= width * F.col("_vol"), 1).when(x <= -width * F.col("_vol"), -1).otherwise(0)), lambda x: x != 0)
    label = F.when(F.size(hit) > 0, F.get(hit, F.lit(0))).otherwise(R.sign(F.get(rel, F.lit(horizon - 1))).cast("int"))
    return df.withColumn("barrier_label", F.when(F.col("_vol").isNotNull() & F.col("_next").isNotNull(), label)).drop("_r", "_vol", "_next")


def forward_labels(df: DataFrame, horizon: int = 5) -> DataFrame:
    f = F.try_divide(R.lead("close", horizon), F.col("close")) - 1
    return df.withColumns({"forward_return": f, "forward_up": F.when(f > 0, 1).when(f.isNotNull(), 0)})


def meta_labels(df: DataFrame, horizon: int = 5, n: int = 20) -> DataFrame:
    """Whether a momentum side would have earned over the horizon, and its rolling accuracy once known."""
    df = forward_labels(df, horizon)
    side = F.signum(R.change("close", horizon))
    df = df.withColumn("_meta", F.when(side * F.col("forward_return") > 0, 1.0).when(side.isNotNull() & F.col("forward_return").isNotNull(), 0.0))
    df = df.withColumn("_known", R.lag("_meta", horizon))
    return df.withColumns({"meta_label": F.col("_meta"), "meta_accuracy": R.mean("_known", n)}).drop("_meta", "_known", "forward_return", "forward_up")


def sequences(df: DataFrame, length: int = 60, step: int = 10, horizon: int = 1) -> DataFrame:
    """Windows of the last `length` closes every `step` rows, with the return that follows."""
    w = R.W.rowsBetween(-(length - 1), 0)
    df = df.withColumns({"_n": F.row_number().over(R.W), "window": F.collect_list("close").over(w), "target": F.try_divide(R.lead("close", horizon), F.col("close")) - 1})
    return df.where((F.size("window") == length) & (F.col("_n") % step == 0) & F.col("target").isNotNull()).drop("_n")
