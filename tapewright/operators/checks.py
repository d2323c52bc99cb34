"""Checks of bars before use: one aggregate per symbol each, severities as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import rolling as R

OHLC = ("open", "high", "low", "close")


def n_if(c: Column) -> Column:
    """Rows where c holds; an unknown doesn't count."""
    return F.count_if(F.coalesce(c, F.lit(False)))


def graded(x, error, warning) -> Column:
    return F.when(x > error, "error").when(x > warning, "warning").otherwise("ok")


def missing(df: DataFrame) -> DataFrame:
    """Share of nulls by symbol and price column, in percent, and its severity."""
    wide = df.groupBy("symbol").agg(*[(100 * F.avg(F.isnull(c).cast("double"))).alias(c) for c in OHLC])
    return wide.unpivot(["symbol"], list(OHLC), "field", "missing_pct").withColumn("severity", graded(F.col("missing_pct"), 5, 0))


def relations(df: DataFrame) -> DataFrame:
    """Rows whose high is under another price, or whose low is over one."""
    o, h, lo, c = (F.col(x) for x in OHLC)
    return df.groupBy("symbol").agg(n_if((h < o) | (h < c) | (h < lo)).alias("high_wrong"), n_if((lo > o) | (lo > c) | (lo > h)).alias("low_wrong"))


def prices(df: DataFrame, tiny: float = 0.01) -> DataFrame:
    """Negative, tiny and infinite prices over all four columns."""
    each = lambda f: F.expr(" + ".join(f"count_if({f.format(c)})" for c in OHLC))
    return df.groupBy("symbol").agg(each("{0} < 0").alias("negative"), each(f"{{0}} >= 0 and {{0}} < {tiny}").alias("tiny"), each("abs({0}) = double('inf')").alias("infinite"))


def volumes(df: DataFrame, sigmas: float = 5.0) -> DataFrame:
    """Negative, zero and outlying volumes; the statistics are a small table joined back."""
    stats = df.groupBy("symbol").agg((F.avg("volume") + sigmas * F.stddev_samp("volume")).alias("cut"))
    v = F.col("volume")
    return df.join(stats, "symbol").groupBy("symbol").agg(n_if(v < 0).alias("negative"), (100 * F.avg((v == 0).cast("double"))).alias("zero_pct"), n_if(v > F.col("cut")).alias("outliers"))


def time_gaps(df: DataFrame, least: int = 60, most: int = 900) -> DataFrame:
    """Gaps in minutes over `least` and under `most` (a night)."""
    gap = (F.unix_timestamp("ts") - F.unix_timestamp(R.lag("ts"))) / 60
    return df.withColumn("gap", gap).where((F.col("gap") > least) & (F.col("gap") < most))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Rows beyond the first with equal symbol and keys."""
    return df.groupBy("symbol", *keys).count().groupBy("symbol").agg(F.sum(F.col("count") - 1).alias("duplicates"))


def summary(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts"), F.max("ts").alias("last"), F.count_if(F.isnull("close")).alias("nulls"), F.min("low").alias("lowest"), F.max("high").alias("highest"), F.avg("close").alias("mean_close"), F.sum("volume").alias("volume"))


def backtest_input(df: DataFrame) -> DataFrame:
    """Counts of likely splits (big return, volume doubled), likely dividends, weekend bars and broken bars, and the verdict."""
    df = df.withColumns({"r": R.pct("close"), "v": R.pct("volume")})
    o, h, lo, c = (F.col(x) for x in OHLC)
    broken = (h < F.greatest(o, c, lo)) | (lo > F.least(o, c, h))
    out = df.groupBy("symbol").agg(
        n_if((F.abs("r") > 0.2) & (F.abs("v") > 1)).alias("splits"), n_if((F.col("r") > -0.1) & (F.col("r") < -0.01) & (F.abs("v") <= 1)).alias("dividends"),
        n_if(F.dayofweek("ts").isin(1, 7)).alias("weekend"), (100 * F.avg(F.coalesce(broken, F.lit(False)).cast("double"))).alias("broken_pct"),
    )
    return out.withColumn("verdict", F.when(F.col("broken_pct") > 1, "reject").when((F.col("dividends") > 12) | (F.col("splits") > 0), "warning").otherwise("ok"))


def alignment(df: DataFrame, reference: str) -> DataFrame:
    """How each symbol's times differ from the reference's: start and end in days, count and missing times in percent."""
    ref = df.where(F.col("symbol") == reference)
    own = df.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
    r = own.where(F.col("symbol") == reference).select(F.col("symbol").alias("reference"), F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("n").alias("rn"))
    shared = df.select("symbol", "ts").distinct().join(ref.select("ts").distinct(), "ts").groupBy("symbol").agg(F.count(F.lit(1)).alias("shared"))
    days = lambda x, y: F.abs(F.unix_timestamp(x) - F.unix_timestamp(y)) / 86400
    j = own.join(shared, "symbol", "left").withColumn("reference", F.lit(reference)).join(r, "reference").withColumns({"start_days": days("a", "ra"), "end_days": days("b", "rb"), "count_pct": 100 * F.abs(F.col("n") - F.col("rn")) / F.col("rn"), "missing_pct": 100 * (1 - F.coalesce("shared", F.lit(0)) / F.col("rn"))})
    bad = (F.col("start_days") > 1) | (F.col("end_days") > 1)
    return j.withColumn("severity", F.when(bad, "error").when((F.col("count_pct") > 10) | (F.col("missing_pct") > 10), "warning").otherwise("ok"))


def long_gaps(df: DataFrame, times: float = 10.0) -> DataFrame:
    """Gaps over `times` the symbol's median gap, in seconds."""
    g = df.withColumn("gap", F.unix_timestamp("ts") - F.unix_timestamp(R.lag("ts")))
    medians = g.groupBy("symbol").agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"))
    return g.join(medians, "symbol").where(F.col("gap") > times * F.col("median_gap"))


def quick(df: DataFrame, least: int = 50) -> DataFrame:
    """Rows, negative prices, missing and zero-volume shares, and long gaps by symbol; `valid` if none is over its bound."""
    base = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), n_if(F.least(*OHLC) < 0).alias("negative"), (100 * F.avg(F.isnull("close").cast("double"))).alias("missing_pct"), (100 * F.avg((F.col("volume") == 0).cast("double"))).alias("zero_pct"))
    gaps = long_gaps(df).groupBy("symbol").agg(F.count(F.lit(1)).alias("gaps"))
    ok = (F.col("n") >= least) & (F.col("negative") == 0) & (F.col("missing_pct") <= 5) & (F.col("zero_pct") <= 10)
    return base.join(gaps, "symbol", "left").fillna(0, ["gaps"]).withColumn("valid", ok.cast("long"))


def sigma_jumps(df: DataFrame, sigmas: float) -> DataFrame:
    """Rows whose return is further than `sigmas` deviations from the symbol's mean return."""
    r = df.withColumn("r", R.pct("close"))
    stats = r.groupBy("symbol").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))
    return r.join(stats, "symbol").where(F.abs(F.col("r") - F.col("m")) > sigmas * F.col("sd"))


def possible_splits(df: DataFrame, down: float = -0.4, up: float = 0.8, first: int = 5) -> DataFrame:
    """The first few rows of each symbol with a return no market explains."""
    x = df.withColumn("r", R.pct("close")).where((F.col("r") < down) | (F.col("r") > up))
    return x.withColumn("k", F.row_number().over(R.W)).where(F.col("k") <= first)


def clipped(df: DataFrame, x: str, n: float = 3.0) -> DataFrame:
    """x clipped, nulled and marked where it is over n deviations from the symbol's mean."""
    stats = df.groupBy("symbol").agg((F.avg(x) - n * F.stddev_samp(x)).alias("a"), (F.avg(x) + n * F.stddev_samp(x)).alias("b"))
    v = F.col(x)
    out = (v < F.col("a")) | (v > F.col("b"))
    return df.join(stats, "symbol").withColumns({"clipped": F.when(v.isNotNull(), F.greatest(F.least(v, F.col("b")), F.col("a"))), "nulled": F.when(~out, v), "outlier": out.cast("double")})


def safe_divide(a, b, fill: float = 0.0) -> Column:
    """a / b; `fill` for a zero divisor, nulls, NaN and infinity."""
    x = F.try_divide(a, b)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), fill).otherwise(x)


def matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature column: nulls, NaNs, infinities, and whether it is constant."""
    parts = [F.struct(F.lit(c).alias("feature"), F.count_if(F.isnull(c)).alias("nulls"), n_if(F.isnan(c)).alias("nans"), n_if(F.abs(c) == float("inf")).alias("infinite"), (F.min(c).eqNullSafe(F.max(c))).cast("long").alias("constant")) for c in columns]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))
