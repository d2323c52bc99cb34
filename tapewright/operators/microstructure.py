"""Order flow, impact and liquidity measures from bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R

def bar_range():
    return F.col("high") - F.col("low")


def tick_rule(df: DataFrame) -> DataFrame:
    """Sign of the price change; ties carry the last sign."""
    d = F.signum(R.change("close"))
    df = df.withColumn("_d", F.when(d != 0, d))
    return df.withColumn("tick_sign", F.last("_d", ignorenulls=True).over(R.RUN)).drop("_d")


def bulk_volume(df: DataFrame, flat: float = 0.0) -> DataFrame:
    """Buy and sell volume by the close's place in the range; `flat` is the buy and sell share of a flat bar."""
    share = F.try_divide(F.col("close") - F.col("low"), bar_range())
    buy = F.col("volume") * F.coalesce(share, F.lit(flat))
    sell = F.col("volume") * F.coalesce(1 - share, F.lit(flat))
    return df.withColumns({"buy_volume": buy, "sell_volume": sell})


def flow_imbalance(df: DataFrame, n: int = 20) -> DataFrame:
    df = bulk_volume(df)
    df = df.withColumn("ofi", F.col("buy_volume") - F.col("sell_volume"))
    low, high = R.lowest("ofi", n), R.highest("ofi", n)
    df = df.withColumns(
        {
            "ofi_z": R.zscore("ofi", n), "ofi_minmax": F.try_divide(F.col("ofi") - low, high - low), "ofi_cumulative": R.running(F.sum, "ofi"),
            "buy_ratio": F.try_divide(F.col("buy_volume"), F.col("buy_volume") + F.col("sell_volume")),
        }
    )
    return df.withColumn("volume_imbalance", R.mean("buy_ratio", n))


def vpin_buckets(df: DataFrame, size: float) -> DataFrame:
    """Equal-volume buckets; a bar that straddles buckets is split in proportion. (symbol, bucket, buy, sell)"""
    df = bulk_volume(df, flat=0.5).where("volume > 0")
    end = R.running(F.sum, "volume")
    df = df.withColumns({"_hi": end, "_lo": end - F.col("volume")})
    first, last = F.floor(F.col("_lo") / size), F.ceil(F.col("_hi") / size) - 1
    df = df.withColumn("bucket", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    over = F.least("_hi", (F.col("bucket") + 1) * size) - F.greatest("_lo", F.col("bucket") * size)
    part = over / F.col("volume")
    return df.groupBy("symbol", "bucket").agg(F.sum(F.col("buy_volume") * part).alias("buy"), F.sum(F.col("sell_volume") * part).alias("sell"), F.max("ts").alias("ts"), F.sum(over).alias("filled"))


def vpin(df: DataFrame, size: float = 500.0, n: int = 50) -> DataFrame:
    """Imbalance over the last n full buckets, and the alert of its rolling maximum."""
    b = vpin_buckets(df, size).where(F.col("filled") >= size)
    w = R.series("symbol", "bucket")
    gap, whole = R.total(F.abs(F.col("buy") - F.col("sell")), n, w=w), R.total(F.col("buy") + F.col("sell"), n, w=w)
    b = b.withColumn("vpin", F.try_divide(gap, whole))
    return b.withColumn("toxic", F.when(R.roll(F.max, "vpin", 10, 1, w=w) > 0.7, 1).otherwise(0))


def signed_flow(df: DataFrame, n: int = 20) -> DataFrame:
    """Signed share of the bar's range times volume over the average volume."""
    s = F.coalesce(2 * F.try_divide(F.col("close") - F.col("low"), bar_range()) - 1, F.lit(0.0))
    return df.withColumns({"_adv": R.mean("volume", n)}).withColumn("signed_flow", s * F.try_divide(F.col("volume"), F.col("_adv"))).drop("_adv")


def kyle_rolling(df: DataFrame, n: int = 60) -> DataFrame:
    """Slope of return on signed flow over the n bars before the current one."""
    df = signed_flow(df).withColumn("_r", R.pct("close"))
    w = R.W.rowsBetween(-n, -1)
    both = F.col("_r").isNotNull() & F.col("signed_flow").isNotNull()
    slope = F.try_divide(F.covar_pop("_r", "signed_flow").over(w), F.var_pop("signed_flow").over(w))
    return df.withColumn("kyle_lambda", F.when(F.count(F.when(both, 1)).over(w) == n, slope)).drop("_r")


def kyle_full(df: DataFrame, least: int = 30) -> DataFrame:
    """Per symbol: slope, r2 and t of return on signed flow, and the mean impact in basis points."""
    df = signed_flow(df).withColumn("_r", R.pct("close")).where("_r is not null and signed_flow is not null")
    g = df.groupBy("symbol").agg(F.regr_slope("_r", "signed_flow").alias("lam"), F.regr_r2("_r", "signed_flow").alias("r2"), F.count(F.lit(1)).alias("n"), F.avg(F.abs("signed_flow")).alias("size"))
    t = F.signum("lam") * F.sqrt(F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")))
    return g.where(F.col("n") >= least).select("symbol", "lam", "r2", t.alias("t_stat"), "n", (F.col("lam") * F.col("size") * 1e4).alias("impact_bps"))


def roll_spread(df: DataFrame, n: int = 20) -> DataFrame:
    """Twice the root of the negative covariance of successive price changes; 0 if it is not negative."""
    df = df.withColumn("_d", R.change("close"))
    df = df.withColumn("_p", R.lag("_d"))
    w = R.W.rowsBetween(-(n - 1), 0)
    cov = F.round(F.covar_samp("_d", "_p").over(w), 12)
    s = F.when(F.count("_p").over(w) == n, F.when(cov < 0, 2 * F.sqrt(-cov)).otherwise(0.0))
    return df.withColumns({"roll_spread": s, "roll_spread_pct": F.try_divide(s, F.col("close"))}).drop("_d", "_p")


def amihud(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumn("_a", F.try_divide(F.abs(R.pct("close")), F.col("close") * F.col("volume")) * 1e6)
    df = df.withColumn("amihud", R.roll(F.avg, "_a", n, 5))
    return df.withColumns({"amihud_log": F.when(F.col("amihud") > 0, F.ln("amihud")), "amihud_relative": F.try_divide(F.col("amihud"), R.roll(F.avg, "amihud", 5 * n, n))}).drop("_a")


def liquidity_score(df: DataFrame, n: int = 60) -> DataFrame:
    """Mean of the z-scores of the Roll spread and of the log of Amihud's measure, null ones as 0: lower is more liquid."""
    df = amihud(roll_spread(df))
    z = [F.coalesce(R.zscore(F.round(c, 12), n, 1e-9), F.lit(0.0)) for c in ("roll_spread_pct", "amihud_log")]
    return df.withColumn("liquidity_score", (z[0] + z[1]) / 2)


def smart_money(df: DataFrame, n: int = 50) -> DataFrame:
    """Blocks are bars over the rolling 95th percentile of volume; what their sides and their moves say.

    A bar's side is where its close lies in its range, above or below the middle.
    """
    w = R.W.rowsBetween(-(n - 1), 0)
    quantile = F.when(F.count("volume").over(w) == n, F.percentile("volume", F.lit(0.95)).over(w))
    df = df.withColumns({"_q": quantile, "_r": F.abs(R.pct("close")), "_s": F.coalesce(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5)) - 0.5})
    df = df.withColumn("block", F.when(F.col("volume") > F.col("_q"), 1.0).otherwise(0.0))
    volume = F.col("block") * F.col("volume")
    df = df.withColumns({"_b": R.total(F.when(F.col("_s") > 0, volume).otherwise(0.0), n), "_d": R.total(F.when(F.col("_s") < 0, volume).otherwise(0.0), n), "block_ratio": R.mean("block", n)})
    impact = F.try_divide(R.mean(F.col("_r") * F.col("block"), n), R.mean(F.col("_r") * (1 - F.col("block")), n))
    df = df.withColumn("impact_ratio", impact)
    active = F.coalesce(F.col("block_ratio") * 0.5 + F.least(F.greatest("impact_ratio", F.lit(0.0)), F.lit(2.0)) / 4, F.lit(0.0))
    flow = F.coalesce(F.try_divide(F.col("_b") - F.col("_d"), F.col("_b") + F.col("_d")), F.lit(0.0))
    return df.withColumns({"smart_money_index": flow, "institutional_activity": F.when(F.col("impact_ratio").isNull(), 0.0).otherwise(active)}).drop("_q", "_r", "_s", "_b", "_d")


def daily_bucket_size(df: DataFrame) -> DataFrame:
    """Bucket sizes by symbol: the first percentile of daily volume, and a hundredth of its mean."""
    day = df.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.sum("volume").alias("v"))
    return day.groupBy("symbol").agg(F.percentile("v", F.lit(0.01)).alias("p01"), (F.avg("v") / 100).alias("adv_share"))


def pair_correlations(df: DataFrame, n: int = 60, least: int | None = None) -> DataFrame:
    """Rolling correlation of the returns of every two symbols, on the times that both have."""
    r = df.withColumn("r", R.pct("close")).where("r is not null").select("symbol", "ts", "r")
    a, b = r.select(F.col("symbol").alias("a"), "ts", F.col("r").alias("ra")), r.select(F.col("symbol").alias("b"), "ts", F.col("r").alias("rb"))
    p = a.join(b, "ts").where("a < b")
    w = Window.partitionBy("a", "b").orderBy("ts").rowsBetween(-(n - 1), 0)
    c = F.try_divide(F.covar_pop("ra", "rb").over(w), F.stddev_pop("ra").over(w) * F.stddev_pop("rb").over(w))
    return p.withColumn("corr", F.when(F.count(F.lit(1)).over(w) >= (least or n), c)).where("corr is not null").select("a", "b", "ts", "corr")


def correlation_regime(df: DataFrame, n: int = 60, least: int = 30) -> DataFrame:
    """Per time: mean and spread of the pair correlations, the label and jumps over 0.2."""
    g = pair_correlations(df, n, least).groupBy("ts").agg(F.avg("corr").alias("avg_corr"), F.stddev_pop("corr").alias("dispersion"), F.count(F.lit(1)).alias("n_pairs"))
    c = F.round("avg_corr", 9)
    return g.withColumn("label", F.when(c < 0.2, "low").when(c < 0.4, "normal").when(c < 0.6, "high").otherwise("crisis"))


def ou_parameters(df: DataFrame) -> DataFrame:
    """Per symbol: mean reversion of the log price from its regression on its own lag."""
    x = F.ln("close")
    s = df.withColumn("x", x).withColumn("p", R.lag("x")).where("p is not null")
    g = s.groupBy("symbol").agg(F.regr_slope("x", "p").alias("b"), F.regr_intercept("x", "p").alias("a"), F.regr_syy("x", "p").alias("syy"), F.regr_sxy("x", "p").alias("sxy"), F.count(F.lit(1)).alias("n"))
    b = F.col("b")
    fit = (b > 0) & (b < 1)
    return g.select(
        "symbol", F.when(fit, -F.ln(b)).alias("theta"), F.when(fit, F.col("a") / (1 - b)).alias("mu"),
        F.when(fit, F.sqrt((F.col("syy") - b * F.col("sxy")) / (F.col("n") - 2))).alias("sigma"), F.when(fit, -math.log(2) / F.ln(b)).alias("half_life"),
    )


def pair_rows(df: DataFrame) -> DataFrame:
    """(a, ts, y, b, x): the closes of every two symbols at the times that both have."""
    s = df.select("symbol", "ts", "close")
    return s.select(F.col("symbol").alias("a"), "ts", F.col("close").alias("y")).join(s.select(F.col("symbol").alias("b"), "ts", F.col("close").alias("x")), "ts").where("a < b")


def pair_spreads(df: DataFrame, n: int = 20) -> DataFrame:
    """For every two symbols: spread with the least-squares hedge ratio of all common times, and its rolling z-score."""
    p = pair_rows(df)
    h = p.groupBy("a", "b").agg(F.regr_slope("y", "x").alias("hedge"))
    p = p.join(h, ["a", "b"])
    p = p.withColumn("spread", F.col("y") - F.col("hedge") * F.col("x"))
    w = Window.partitionBy("a", "b").orderBy("ts")
    return p.withColumn("z", F.try_divide(F.col("spread") - R.mean("spread", n, w=w), R.std("spread", n, w=w) + 1e-8)).select("a", "b", "ts", "hedge", "spread", "z")


def earlier_share(x: str, n: int) -> Column:
    """Share of the n - 1 values before a row that are below its own, equal ones half; null until n values are there."""
    past = F.collect_list(x).over(R.series().rowsBetween(-(n - 1), -1))
    below, upto = F.size(F.filter(past, lambda v: v < F.col(x))), F.size(F.filter(past, lambda v: v <= F.col(x)))
    return F.when(F.col(x).isNotNull() & (F.size(past) == n - 1), (below + upto + (below < upto).cast("int")) / 2 / (n - 1))


def spread_analytics(df: DataFrame, n: int = 20, history: int = 100) -> DataFrame:
    """A bar's range as its spread in basis points, with momentum, z-score and its place among the `history` - 1 before it."""
    df = df.withColumn("spread_bps", F.try_divide(F.col("high") - F.col("low"), (F.col("high") + F.col("low")) / 2) * 10_000)
    return df.withColumns({"spread_momentum": R.change("spread_bps", 5), "spread_z": R.zscore("spread_bps", n), "spread_place": earlier_share("spread_bps", history)})


def toxicity(df: DataFrame, n: int = 20) -> DataFrame:
    """0.4 flow imbalance, 0.3 place of illiquidity and 0.3 place of the deviation of absolute returns; 0.5 where one is unknown."""
    at = F.coalesce(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))
    df = df.withColumns({"buy": F.col("volume") * at, "sell": F.col("volume") * (1 - at), "move": F.abs(R.pct("close"))})
    buy, sell = R.total("buy", n), R.total("sell", n)
    df = df.withColumns({"imbalance": F.try_divide(F.abs(buy - sell), buy + sell), "illiquidity": F.round(F.try_divide("move", F.try_divide("volume", R.mean("volume", n))), 12), "clustering": F.round(R.std("move", n), 12)})
    return df.withColumn("toxicity", F.coalesce(0.4 * F.col("imbalance") + 0.3 * earlier_share("illiquidity", n) + 0.3 * earlier_share("clustering", n), F.lit(0.5)))


def reverting(df: DataFrame, n: int = 100, least: float = 5.0, most: float = 50.0) -> DataFrame:
    """Slope of changes on levels over the n rows before a row, and whether its half-life is between the bounds."""
    before = R.lag("close")
    df = df.withColumns({"level": before, "delta": F.col("close") - before, "k": F.row_number().over(R.W)})
    frame = R.series().rowsBetween(-(n - 1), -1)
    slope = F.try_divide(F.covar_samp("delta", "level").over(frame), F.var_pop("level").over(frame))
    df = df.withColumn("slope", F.when(F.col("k") > n, slope))
    half = F.when(F.col("slope") < 0, -math.log(2) / F.col("slope"))
    return df.withColumn("reverting", F.coalesce((half > least) & (half < most), F.lit(False)).cast("long"))
