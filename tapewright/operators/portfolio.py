"""Weights to backtests, costs, limits and rebalancing, as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R

def at():
    """All rows of one time."""
    return Window.partitionBy("ts")


def growth(r) -> Column:
    """Log of 1 + r; a loss of everything or more (shorts can lose more) leaves a millionth."""
    return F.ln(F.greatest((F.col(r) if isinstance(r, str) else r) + 1, F.lit(1e-6)))


def backtest(df: DataFrame, commission: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    """df: (symbol, ts, r, weight). Weights act one bar later; costs are turnover times the rates; equity compounds.

    Per symbol only lags are needed; sums per time are combined before their shuffle. The running
    product is over one row per time.
    """
    held = F.coalesce(R.lag("weight"), F.lit(0.0))
    df = df.withColumn("held", held).withColumn("trade", F.abs(F.col("held") - F.coalesce(R.lag("held"), F.lit(0.0))))
    g = df.groupBy("ts").agg(F.sum(F.coalesce(F.col("held") * F.col("r"), F.lit(0.0))).alias("gross"), (F.sum("trade") / 2).alias("turnover"), F.sum(F.abs("held")).alias("exposure"))
    g = g.withColumn("net", F.col("gross") - F.col("turnover") * (commission + slippage))
    every = Window.partitionBy(F.lit(1)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("equity", F.exp(F.sum(growth("net")).over(every)))


def cost_grid(per_time: DataFrame, costs: list[float]) -> DataFrame:
    """Total return and Sharpe ratio of (ts, gross, turnover) under each cost rate; the grid is exploded, not joined."""
    g = per_time.withColumn("cost", F.explode(F.array(*map(F.lit, costs))))
    net = F.col("gross") - F.col("turnover") * F.col("cost")
    return g.groupBy("cost").agg((F.exp(F.sum(growth(net))) - 1).alias("total_return"), F.try_divide(F.avg(net), F.stddev_samp(net)).alias("sharpe"))


def break_even(grid: DataFrame) -> DataFrame:
    """The cost at which the total return crosses zero, by interpolation between grid points."""
    w = Window.partitionBy(F.lit(1)).orderBy("cost")  # one row per grid point
    g = grid.withColumns({"_c": F.lead("cost").over(w), "_t": F.lead("total_return").over(w)})
    cross = g.where((F.col("total_return") > 0) & (F.col("_t") <= 0))
    at = F.col("cost") + (F.col("_c") - F.col("cost")) * F.col("total_return") / (F.col("total_return") - F.col("_t"))
    return cross.agg(F.min(at).alias("break_even"))


def percentage_cost(value: Column, volume_share: Column, commission: float = 0.001, slippage: float = 0.0005, least: float = 1.0, power: float = 0.5) -> Column:
    return F.greatest(value * commission, F.lit(least)) + value * slippage + value * 0.001 * F.pow(volume_share, power)


def slippage(model: str, price: Column, volatility: Column, share: Column, rate: float = 0.0005) -> Column:
    return {"fixed": price * rate, "volatility": price * volatility * 0.1, "volume": price * rate * (1 + share * 10)}[model]


def square_root_impact(volatility: Column, share: Column) -> Column:
    return volatility * F.sqrt(F.greatest(share, F.lit(0.0)))


def kelly(p: Column, b: Column, most: float = 0.5) -> Column:
    """(p b - q) / b, between 0 and `most`."""
    return F.greatest(F.lit(0.0), F.least(F.lit(most), F.try_divide(p * b - (1 - p), b)))


def confidence_size(p: Column, method: str = "linear") -> Column:
    c = F.greatest(F.lit(0.0), 2 * p - 1)
    return {"linear": c, "quadratic": c * c, "sigmoid": 1 / (1 + F.exp(-10 * (p - 0.5)))}[method]


def limit_weights(df: DataFrame, position: float = 0.2, sector: float = 0.4, leverage: float = 1.5) -> DataFrame:
    """Position, then sector, then leverage limits of (ts, symbol, sector, weight)."""
    df = df.withColumn("w1", F.greatest(F.lit(-position), F.least(F.lit(position), F.col("weight"))))
    by_sector = F.sum(F.abs("w1")).over(Window.partitionBy("ts", "sector"))
    df = df.withColumn("w2", F.col("w1") * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(sector), by_sector), F.lit(1.0))))
    gross = F.sum(F.abs("w2")).over(at())
    return df.withColumn("w3", F.col("w2") * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(leverage), gross), F.lit(1.0))))


def violations(df: DataFrame, position: float = 0.2, sector: float = 0.4, leverage: float = 1.5) -> DataFrame:
    """(ts, rule, subject, value, bound) where raw weights break a rule."""
    a = df.where(F.abs("weight") > position).select("ts", F.lit("position").alias("rule"), F.col("symbol").cast("string").alias("subject"), F.abs("weight").alias("value"), F.lit(position).alias("bound"))
    s = df.groupBy("ts", "sector").agg(F.sum(F.abs("weight")).alias("value")).where(F.col("value") > sector)
    g = df.groupBy("ts").agg(F.sum(F.abs("weight")).alias("value")).where(F.col("value") > leverage)
    return a.union(s.select("ts", F.lit("sector"), F.col("sector"), "value", F.lit(sector))).union(g.select("ts", F.lit("leverage"), F.lit("all"), "value", F.lit(leverage)))


def trades(current: DataFrame, target: DataFrame, value: float = 1e6, least: float = 0.001) -> DataFrame:
    """Changes over `least` between two weight tables (symbol, weight); a symbol of one side only counts as 0 on the other."""
    c, t = current.select("symbol", F.col("weight").alias("a")), target.select("symbol", F.col("weight").alias("b"))
    j = c.join(t, "symbol", "full_outer").select("symbol", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    d = F.col("b") - F.col("a")
    return j.where(F.abs(d) >= least).select("symbol", d.alias("change"), F.when(d > 0, "BUY").otherwise("SELL").alias("side"), (F.abs(d) * value).alias("value"))


def capped_turnover(j: DataFrame, most: float = 0.2) -> DataFrame:
    """j: (symbol, change). Scales all changes so that half their sum is at most `most`."""
    turn = F.sum(F.abs("change")).over(Window.partitionBy(F.lit(1))) / 2
    return j.withColumn("capped", F.col("change") * F.least(F.lit(1.0), F.try_divide(F.lit(most), turn)))


def rebalance_flags(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    """df: (ts, symbol, weight, target). First bar of each day or month, and drift of any symbol over the threshold."""
    g = df.groupBy("ts").agg(F.max(F.abs(F.col("weight") - F.col("target"))).alias("max_drift"))
    w = Window.partitionBy(F.lit(1)).orderBy("ts")  # one row per time
    prev = F.lag("ts").over(w)
    flag = lambda unit: F.when(prev.isNull() | (F.date_trunc(unit, "ts") != F.date_trunc(unit, prev)), 1).otherwise(0)
    return g.withColumns({"new_day": flag("day"), "new_month": flag("month"), "drifted": F.when(F.col("max_drift") > threshold, 1).otherwise(0)})


def inverse_volatility(returns: DataFrame, target: float | None = None) -> DataFrame:
    """returns: (symbol, r). Weights in proportion to 1 / volatility."""
    g = returns.groupBy("symbol").agg(F.stddev_samp("r").alias("vol")).where("vol > 0")
    return g.withColumn("weight", 1 / F.col("vol") / F.sum(1 / F.col("vol")).over(Window.partitionBy(F.lit(1))))


def covariances(returns: DataFrame) -> DataFrame:
    """Long covariance matrix (a, b, cov, corr, n) of (symbol, ts, r) on the times that both symbols have."""
    x, y = returns.select(F.col("symbol").alias("a"), "ts", F.col("r").alias("x")), returns.select(F.col("symbol").alias("b"), "ts", F.col("r").alias("y"))
    g = x.join(y, "ts").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"), F.count(F.lit(1)).alias("n"))
    return g.select("a", "b", "cov", F.try_divide(F.col("cov"), F.col("sx") * F.col("sy")).alias("corr"), "n")


def risk_contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """w_i (C w)_i, its share of the variance, and the portfolio's volatility."""
    wa, wb = weights.select(F.col("symbol").alias("a"), F.col("weight").alias("wa")), weights.select(F.col("symbol").alias("b"), F.col("weight").alias("wb"))
    g = cov.join(wa, "a").join(wb, "b").groupBy("a").agg(F.sum(F.col("cov") * F.col("wa") * F.col("wb")).alias("contribution"))
    whole = F.sum("contribution").over(Window.partitionBy(F.lit(1)))
    return g.select(F.col("a").alias("symbol"), "contribution", F.try_divide(F.col("contribution"), whole).alias("share"), F.sqrt(whole).alias("volatility"))


def breaker_levels(df: DataFrame, levels: tuple[float, ...] = (0.07, 0.13, 0.20)) -> DataFrame:
    """df: (symbol, ts, close). First time of each day at which the fall from the day's first price reaches a level."""
    day = F.to_date("ts")
    first = F.first_value("close").over(Window.partitionBy("symbol", day).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    f = df.withColumns({"day": day, "fall": 1 - F.col("close") / first})
    f = f.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).where(F.round("fall", 12) >= F.col("level"))
    return f.groupBy("symbol", "day", "level").agg(F.min("ts").alias("ts"))


def volatility_breaker(df: DataFrame, short: int = 5, long: int = 60, halt: float = 3.0, warn: float = 2.0) -> DataFrame:
    df = df.withColumn("_r", R.pct("close"))
    df = df.withColumn("vol_ratio", F.try_divide(R.roll(F.stddev_pop, "_r", short), R.roll(F.stddev_pop, "_r", long)))
    return df.withColumn("breaker", F.when(F.col("vol_ratio") > halt, "halt").when(F.col("vol_ratio") > warn, "reduce").when(F.col("vol_ratio").isNotNull(), "normal")).drop("_r")


def rapid_loss(df: DataFrame, minutes: int = 60, limit: float = 0.05) -> DataFrame:
    """Fall from the highest close of the last `minutes`, by time and not by rows."""
    w = Window.partitionBy("symbol").orderBy(F.unix_timestamp("ts")).rangeBetween(-60 * minutes, 0)
    df = df.withColumn("rapid_loss", F.col("close") / F.max("close").over(w) - 1)
    return df.withColumn("rapid_flag", F.when(F.col("rapid_loss") <= -limit, 1).otherwise(0))
