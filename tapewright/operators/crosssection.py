"""Cross-sections: ranks, scores and signals among the symbols of one time. Input: symbol, ts and a score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R

def at():
    """All rows of one time."""
    return Window.partitionBy("ts")


def rank_pct(x, *by: str) -> Column:
    """Average-tie rank over the count, 0 to 1."""
    by = by or ("ts",)
    return F.try_divide(R.average_rank(x, *by), F.count(F.col(x) if isinstance(x, str) else x).over(Window.partitionBy(*by)))


def scores(df: DataFrame, x: str) -> DataFrame:
    """Rank share, z-score and difference from the mean of the time."""
    c = F.col(x)
    return df.withColumns({"cs_rank": rank_pct(x), "cs_z": (c - F.avg(c).over(at())) / (F.stddev_samp(c).over(at()) + 1e-10), "cs_relative": c - F.avg(c).over(at())})


def percentile_of_score(df: DataFrame, x: str) -> DataFrame:
    """Mean of the strict and the weak percentile."""
    n = F.count(x).over(at())
    return df.withColumn("cs_percentile", F.when(F.col(x).isNotNull(), F.try_divide(R.average_rank(x, "ts") - 0.5, n)))


def sector_relative(df: DataFrame, x: str) -> DataFrame:
    return df.withColumn("sector_relative", F.col(x) - F.avg(x).over(Window.partitionBy("ts", "sector")))


def sector_momentum(df: DataFrame, n: int = 5) -> DataFrame:
    """Rolling sum of the return less that of its sector's mean."""
    df = df.withColumn("_m", F.when(F.col("r").isNotNull(), F.avg("r").over(Window.partitionBy("ts", "sector"))))
    return df.withColumn("sector_momentum", R.total("r", n) - R.total("_m", n)).drop("_m")


def momentum_composite(df: DataFrame, lookbacks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Mean over lookbacks of the rank share of the return, less one half."""
    df = df.withColumns({f"_p{k}": F.round(R.pct("close", k), 12) for k in lookbacks})
    ranks = [rank_pct(f"_p{k}") - 0.5 for k in lookbacks]
    return df.withColumn("momentum_score", reduce(lambda a, b: a + b, ranks) / len(ranks)).drop(*[f"_p{k}" for k in lookbacks])


def volume_momentum(df: DataFrame, n: int = 5) -> DataFrame:
    """Share of up volume less down volume over n bars, ranked."""
    d = R.change("close")
    signed = F.when(d > 0, F.col("volume")).when(d < 0, -F.col("volume")).when(d.isNotNull(), 0)
    df = df.withColumn("_s", signed.cast("double"))
    df = df.withColumn("_v", F.round(F.try_divide(R.total("_s", n), R.total("volume", n)), 12))
    return df.withColumn("volume_momentum", rank_pct("_v") - 0.5).drop("_s", "_v")


def risk_adjusted_momentum(df: DataFrame, n: int = 5) -> DataFrame:
    df = df.withColumn("_r", R.pct("close"))
    df = df.withColumn("_q", F.round(F.try_divide(R.mean("_r", n), R.std("_r", n)), 9))
    return df.withColumn("risk_adjusted_momentum", rank_pct("_q") - 0.5).drop("_r", "_q")


def top_bottom(df: DataFrame, x: str, n: int = 10, least: float = 0.0) -> DataFrame:
    """1 for the n highest scores above `least`, -1 for the n lowest below -least (shorts win), else 0; ties by symbol."""
    high = F.row_number().over(at().orderBy(F.col(x).desc_nulls_last(), "symbol"))
    low = F.row_number().over(at().orderBy(F.col(x).asc_nulls_last(), "symbol"))
    short = (low <= n) & (F.col(x) < -least)
    return df.withColumn("signal", F.when(short, -1.0).when((high <= n) & (F.col(x) > least), 1.0).otherwise(0.0))


def equal_weights(df: DataFrame) -> DataFrame:
    """1/n for each of the n longs, -1/n for each of the n shorts of a time."""
    n = F.count(F.lit(1)).over(Window.partitionBy("ts", F.signum("signal")))
    return df.withColumn("weight", F.when(F.col("signal") != 0, F.col("signal") / n).otherwise(0.0))


def clipped_weights(df: DataFrame, most: float = 0.1) -> DataFrame:
    """Signal over the number of active ones, clipped."""
    n = F.sum(F.when(F.col("signal") != 0, 1).otherwise(0)).over(at())
    return df.withColumn("weight", F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce(F.try_divide(F.col("signal"), n), F.lit(0.0)))))


def combine(long: DataFrame, weights: dict[str, float]) -> DataFrame:
    """long: (ts, symbol, strategy, signal). Weighted mean, vote, mean of sign and strongest per row of time and symbol."""
    whole = sum(weights.values())
    w = F.create_map(*[F.lit(v) for k in weights.items() for v in (k[0], k[1] / whole)])[F.col("strategy")]
    g = long.groupBy("ts", "symbol").agg(
        F.sum(F.coalesce(F.col("signal"), F.lit(0.0)) * w).alias("weighted"), F.avg(F.signum("signal")).alias("mean_sign"),
        F.max_by("signal", F.struct(F.abs("signal"), "strategy")).alias("strongest"), F.count("signal").alias("n"),
        F.sum(F.when(F.col("signal") > 0, 1).otherwise(0)).alias("n_long"), F.sum(F.when(F.col("signal") < 0, 1).otherwise(0)).alias("n_short"),
    )
    vote = F.when(F.col("mean_sign") > 0.5, 1.0).when(F.col("mean_sign") < -0.5, -1.0).otherwise(0.0)
    agree = F.greatest("n_long", "n_short", F.col("n") - F.col("n_long") - F.col("n_short")) / F.col("n")
    return g.withColumns({"vote": vote, "agreement": agree})


def discretise(x: Column, cut: float = 0.3) -> Column:
    return F.when(x > cut, 1.0).when(x < -cut, -1.0).otherwise(0.0)


def signal_statistics(long: DataFrame) -> DataFrame:
    s = F.col("signal")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return long.groupBy("strategy").agg(
        F.count("signal").alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("sd"), share(s > 0).alias("long_share"), share(s < 0).alias("short_share"), share(s == 0).alias("flat_share"),
        F.sum(F.when(s.isNull() | (F.abs(s) > 1), 1).otherwise(0)).alias("n_invalid"),
    )


def strategy_weights(returns: DataFrame, last: int = 20, floor: float = 0.1) -> DataFrame:
    """returns: (strategy, ts, r). Positive recent Sharpe ratios, at least floor/n, normalised."""
    recent = returns.withColumn("_k", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("ts")))).where(F.col("_k") <= last)
    g = recent.groupBy("strategy").agg(F.coalesce(F.try_divide(F.avg("r"), F.stddev_samp("r")), F.lit(0.0)).alias("sharpe"))
    every = Window.partitionBy(F.lit(1))  # one row per strategy
    raw = F.greatest(F.col("sharpe"), F.lit(floor) / F.count(F.lit(1)).over(every))
    return g.withColumn("_raw", raw).withColumn("weight", F.col("_raw") / F.sum("_raw").over(every)).drop("_raw")
