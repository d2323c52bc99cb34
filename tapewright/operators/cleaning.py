"""Validation, repair and preprocessing of bars and feature tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R

PRICES = ("open", "high", "low", "close")


def n_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def checks(df: DataFrame, missing: float = 5.0, jump: float = 50.0, gap_minutes: int = 60, night_hours: int = 15) -> DataFrame:
    """One row per symbol with all counts: missing, inconsistent, invalid, jumps, volume, gaps; and whether it is valid.

    One window pass for the lags, one aggregation; volume outliers need the mean first and are counted
    from a second aggregation joined on symbol.
    """
    null_any = F.greatest(*[F.avg(F.when(F.col(c).isNull(), 100.0).otherwise(0.0)) for c in PRICES])
    lagged = df.withColumns({"_r": R.pct("close"), "_gap": F.unix_timestamp("ts") - F.unix_timestamp(R.lag("ts"))})
    a = lagged.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), null_any.alias("missing_pct"), n_if(F.col("high") < F.greatest("open", "close", "low")).alias("n_high"), n_if(F.col("low") > F.least("open", "close", "high")).alias("n_low"),
        n_if(F.least(*PRICES) < 0).alias("n_negative"), n_if(F.least(*PRICES) < 0.01).alias("n_tiny"), n_if(F.abs("_r") * 100 > jump).alias("n_jumps"),
        n_if(F.col("volume") < 0).alias("n_negative_volume"), F.avg(F.when(F.col("volume") == 0, 100.0).otherwise(0.0)).alias("zero_volume_pct"),
        n_if((F.col("_gap") > 60 * gap_minutes) & (F.col("_gap") < 3600 * night_hours)).alias("n_gaps"), F.avg("volume").alias("_m"), F.stddev_samp("volume").alias("_s"),
        (F.count("ts") - F.countDistinct("ts")).alias("n_duplicates"),
    )
    v = df.join(a.select("symbol", "_m", "_s"), "symbol").groupBy("symbol").agg(n_if(F.col("volume") > F.col("_m") + 5 * F.col("_s")).alias("n_volume_outliers"))
    a = a.join(v, "symbol").drop("_m", "_s")
    errors = sum((F.when(c, 1).otherwise(0) for c in (F.col("n_high") > 0, F.col("n_low") > 0, F.col("n_negative") > 0, F.col("n_negative_volume") > 0)), F.when(F.col("missing_pct") > missing, 1).otherwise(0))
    warnings = sum((F.when(c, 1).otherwise(0) for c in (F.col("n_jumps") > 0, F.col("n_gaps") > 0, F.col("n_duplicates") > 0, F.col("n_volume_outliers") > 0, F.col("n_tiny") > 0)), F.when(F.col("zero_volume_pct") > 10, 1).otherwise(0))
    return a.withColumns({"n_errors": errors, "n_warnings": warnings, "is_valid": F.when(errors == 0, 1).otherwise(0)})


def jumps(df: DataFrame, least: float = 50.0) -> DataFrame:
    d = df.withColumn("jump_pct", 100 * R.pct("close"))
    return d.where(F.abs("jump_pct") > least).select("symbol", "ts", "jump_pct")


def splits(df: DataFrame) -> DataFrame:
    """Overnight open against the previous close: forward below -40 %, reverse above 150 %, with the rounded ratio."""
    d = df.withColumn("_p", R.lag("close")).withColumn("move", F.try_divide(F.col("open"), F.col("_p")) - 1)
    ratio = F.when(F.col("move") < 0, F.try_divide(F.col("_p"), F.col("open"))).otherwise(F.try_divide(F.col("open"), F.col("_p")))
    kind = F.when(F.col("move") < -0.4, "forward").when(F.col("move") > 1.5, "reverse")
    return d.withColumns({"kind": kind, "ratio": F.round(ratio).cast("bigint")}).where("kind is not null").select("symbol", "ts", "kind", "ratio", "move")


def dividends(df: DataFrame) -> DataFrame:
    d = df.withColumn("_p", R.lag("close")).withColumn("drop", 1 - F.try_divide(F.col("open"), F.col("_p")))
    return d.where("drop > 0.005 and drop < 0.10").select("symbol", "ts", "drop", (F.col("drop") * F.col("_p")).alias("amount"))


def with_holes(df: DataFrame, every: int = 7, x: str = "close") -> DataFrame:
    """x without some of its values (those whose epoch quarter-hours divide by `every`), to fill again."""
    return df.withColumn(x, F.when((F.unix_timestamp("ts") / 900).cast("bigint") % every != 0, F.col(x)))


def fill(df: DataFrame, x: str = "close", limit: int = 10) -> DataFrame:
    """Forward fill over at most `limit` rows, then backward the same."""
    back = R.W.rowsBetween(-limit, 0)
    df = df.withColumn("_f", F.last(x, ignorenulls=True).over(back))
    return df.withColumn(f"{x}_filled", F.coalesce("_f", F.first("_f", ignorenulls=True).over(R.W.rowsBetween(0, limit)))).drop("_f")


def interpolate(df: DataFrame, x: str = "close") -> DataFrame:
    """Linear in time between the values before and after a hole."""
    known = F.when(F.col(x).isNotNull(), F.struct(F.unix_timestamp("ts").alias("t"), F.col(x).alias("v")))
    df = df.withColumn("_k", known)
    a, b = F.last("_k", ignorenulls=True).over(R.RUN), F.first("_k", ignorenulls=True).over(R.W.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"_a": a, "_b": b})
    at = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.try_divide(F.unix_timestamp("ts") - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    return df.withColumn(f"{x}_interpolated", F.coalesce(F.col(x), at)).drop("_k", "_a", "_b")


def repair(df: DataFrame) -> DataFrame:
    """High becomes the largest of the four prices, then low the smallest."""
    df = df.withColumn("high", F.greatest(*PRICES))
    return df.withColumn("low", F.least(*PRICES))


def first_rows(df: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def clip_returns(df: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Returns clipped to mean +- sigmas sd of the series, and the price rebuilt from the last unclipped one.

    A run of clipped rows compounds from the close before it: a running sum of logs inside the run.
    """
    whole = Window.partitionBy("symbol")
    df = df.withColumn("_r", R.pct("close"))
    m, s = F.avg("_r").over(whole), F.stddev_samp("_r").over(whole)
    df = df.withColumns({"_lo": m - sigmas * s, "_hi": m + sigmas * s})
    df = df.withColumn("clipped_return", F.greatest(F.least("_r", "_hi"), "_lo")).withColumn("_out", F.when((F.col("_r") > F.col("_hi")) | (F.col("_r") < F.col("_lo")), 1).otherwise(0))
    df = df.withColumn("_run", R.islands("_out")).withColumn("_p", R.lag("close"))
    w = Window.partitionBy("symbol", "_run").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.first("_p").over(w) * F.exp(F.sum(F.ln(F.greatest(1 + F.col("clipped_return"), F.lit(1e-9)))).over(w))
    return df.withColumn("close_clipped", F.when(F.col("_out") == 1, grown).otherwise(F.col("close"))).drop("_r", "_lo", "_hi", "_out", "_run", "_p")


def fit_stats(df: DataFrame, x: str, by: str = "symbol") -> DataFrame:
    """Fitted once on training rows: percentiles, mean, sds, extremes."""
    p = lambda q: F.percentile(x, F.lit(q))
    return df.groupBy(by).agg(
        p(0.01).alias("p01"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"), p(0.99).alias("p99"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd_pop"), F.stddev_samp(x).alias("sd"),
        F.min(x).alias("least"), F.max(x).alias("most"),
    )


def preprocess(train: DataFrame, rows: DataFrame, x: str, by: str = "symbol") -> DataFrame:
    """Winsorised, sigma-clipped, standard, robust and min-max forms of x, fitted on `train` only."""
    j = rows.join(fit_stats(train, x, by), by)
    c = F.col(x)
    return j.select(
        *rows.columns, F.greatest(F.least(c, "p99"), "p01").alias("winsorised"), F.greatest(F.least(c, F.col("mean") + 5 * F.col("sd_pop")), F.col("mean") - 5 * F.col("sd_pop")).alias("sigma_clipped"),
        F.try_divide(c - F.col("mean"), F.col("sd_pop")).alias("standard"), F.try_divide(c - F.col("p50"), F.col("p75") - F.col("p25")).alias("robust"), F.try_divide(c - F.col("least"), F.col("most") - F.col("least")).alias("min_max"),
    )


def infinities(df: DataFrame, x: str) -> DataFrame:
    """+-infinity becomes 1.5 times the largest or smallest finite value of the symbol."""
    inf = float("inf")
    finite = F.when(F.abs(x) != inf, F.col(x))
    w = Window.partitionBy("symbol")
    return df.withColumn(f"{x}_finite", F.when(F.col(x) == inf, 1.5 * F.max(finite).over(w)).when(F.col(x) == -inf, 1.5 * F.min(finite).over(w)).otherwise(F.col(x)))


def calendar(df: DataFrame) -> DataFrame:
    """Session, cyclical time, distances to open and close, boundaries, expiry and rate-decision weeks."""
    m = F.hour("ts") * 60 + F.minute("ts")
    day, wd = F.dayofmonth("ts"), F.weekday("ts")
    session = F.when((m >= 240) & (m < 570), 0).when((m >= 570) & (m < 960), 1).when((m >= 960) & (m < 1200), 2).otherwise(-1)
    turn = lambda x, n: (F.sin(2 * math.pi * x / n), F.cos(2 * math.pi * x / n))
    out = {"session": session, "is_regular": F.when(session == 1, 1).otherwise(0), "minutes_to_open": F.lit(570) - m, "minutes_to_close": F.lit(960) - m, "first_half_hour": F.when((m >= 570) & (m < 600), 1).otherwise(0), "last_half_hour": F.when((m >= 930) & (m < 960), 1).otherwise(0)}
    for name, x, n in (("hour", F.hour("ts"), 24), ("minute", F.minute("ts"), 60), ("weekday", wd, 7), ("month", F.month("ts"), 12), ("quarter", F.quarter("ts"), 4)):
        out[f"{name}_sin"], out[f"{name}_cos"] = turn(x, n)
    third_friday = F.date_add(F.next_day(F.date_sub(F.trunc("ts", "month"), 1), "Fri"), 14)
    monday = F.date_sub(F.to_date("ts"), wd)
    out["expiry_week"] = F.when((monday == F.date_sub(third_friday, 4)) & (wd < 5), 1).otherwise(0)
    out["rate_week"] = F.when(F.month("ts").isin(1, 3, 5, 6, 7, 9, 11, 12) & day.between(15, 21) & (wd < 5), 1).otherwise(0)
    return df.withColumns(out)


def trading_calendar(spark, start: str, end: str) -> DataFrame:
    """Quarter hours from 09:30 to 16:00 of business days."""
    days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS d").where(F.weekday("d") < 5)
    first = F.col("d").cast("timestamp") + F.expr("interval 9 hours 30 minutes")
    last = F.col("d").cast("timestamp") + F.expr("interval 16 hours")
    return days.select(F.explode(F.sequence(first, last, F.expr("interval 15 minutes"))).alias("ts"))
