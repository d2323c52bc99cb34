"""Stress tests, liquidity, simulated VaR, factor regressions and portfolio-level risk."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.simulation import draw


def stress(positions: DataFrame, scenarios: list[tuple[str, float, dict[str, float]]], floor: float = -1.0) -> DataFrame:
    """positions: (symbol, sector, value, beta); scenarios: (name, market shock, sector shocks). Loss by scenario.

    A position moves by beta times the market's shock plus its sector's, and not below `floor`. The few
    scenarios are exploded onto the positions; nothing is joined.
    """
    spark_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,double>")
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(m).alias("market"), spark_map(x).alias("shocks")) for n, m, x in scenarios])).alias("s")
    p = positions.select("symbol", "sector", "value", "beta", s).select("symbol", "sector", "value", "beta", "s.*")
    move = F.greatest(F.lit(floor), F.col("beta") * F.col("market") + F.coalesce(F.try_element_at("shocks", F.col("sector")), F.lit(0.0)))
    return p.groupBy("scenario").agg(F.sum(F.col("value") * move).alias("pnl"), F.sum("value").alias("value"), F.sum(F.when(move < -0.2, 1).otherwise(0)).alias("n_hard_hit"), F.min_by("symbol", F.struct(F.round(F.col("value") * move, 6), "symbol")).alias("worst")).withColumn("pnl_share", F.try_divide(F.col("pnl"), F.col("value")))


def stress_summary(losses: DataFrame) -> DataFrame:
    return losses.agg(F.min_by("scenario", "pnl_share").alias("worst_scenario"), F.avg("pnl_share").alias("mean_share"), *[F.sum(F.when(F.col("pnl_share") < -c, 1).otherwise(0)).alias(f"beyond_{int(100 * c)}") for c in (0.05, 0.1, 0.2)])


def liquidity(positions: DataFrame, participation: float = 0.1) -> DataFrame:
    """positions: (symbol, value, adv, volatility). Days to sell, impact and the shares that are sold in 1 and 5 days."""
    days = F.try_divide("value", F.col("adv") * participation)
    impact = F.least(F.lit(0.2), F.col("volatility") * F.sqrt(F.try_divide("value", "adv")))
    return positions.withColumns({"days": days, "impact": impact, "sold_1": F.least(F.lit(1.0), F.try_divide(F.lit(1.0), days)), "sold_5": F.least(F.lit(1.0), F.try_divide(F.lit(5.0), days))})


def liquidity_profile(positions: DataFrame, by: str) -> DataFrame:
    w = F.sum("value")
    mean = lambda c: F.try_divide(F.sum(F.col("value") * F.col(c)), w)
    return liquidity(positions).groupBy(by).agg(w.alias("value"), mean("days").alias("mean_days"), mean("sold_1").alias("liquid_1"), mean("sold_5").alias("liquid_5"), mean("impact").alias("mean_impact"))


def simulated_var(stats: DataFrame, draws: int = 10_000, seed: int = 7, shares: tuple[float, float] = (0.05, 0.01)) -> DataFrame:
    """stats: (symbol, mean, sd). Percentiles of mean + sd * z with z from hashed uniforms by Box and Muller."""
    u = stats.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u1 = (draw(seed, "k", F.lit("a")) + 1) / F.lit(2.0**32 + 1)
    u2 = draw(seed, "k", F.lit("b")) / F.lit(2.0**32)
    z = F.sqrt(-2 * F.ln(u1)) * F.cos(2 * math.pi * u2)
    r = F.col("mean") + F.col("sd") * z
    return u.groupBy("symbol").agg(F.percentile(r, F.lit(shares[0])).alias("var_95"), F.percentile(r, F.lit(shares[1])).alias("var_99"))


def two_factor(df: DataFrame, by: str = "symbol") -> DataFrame:
    """df: (by, y, x1, x2). Least squares with intercept from second moments, solved in closed form per group."""
    g = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in (("x1", "x1"), ("x2", "x2"), ("x1", "x2"), ("x1", "y"), ("x2", "y"), ("y", "y"))], *[F.avg(c).alias(f"m_{c}") for c in ("y", "x1", "x2")],
    )
    c = F.col
    det = c("x1x1") * c("x2x2") - c("x1x2") * c("x1x2")
    g = g.withColumns({"beta_1": F.try_divide(c("x1y") * c("x2x2") - c("x2y") * c("x1x2"), det), "beta_2": F.try_divide(c("x2y") * c("x1x1") - c("x1y") * c("x1x2"), det)})
    explained = c("beta_1") * c("x1y") + c("beta_2") * c("x2y")
    return g.select(by, "n", "beta_1", "beta_2", (c("m_y") - c("beta_1") * c("m_x1") - c("beta_2") * c("m_x2")).alias("alpha"), F.try_divide(explained, c("yy")).alias("r2"), explained.alias("systematic"), (c("yy") - explained).alias("specific"))


def diversification(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted volatility over portfolio volatility, and 1 / sum of squared shares."""
    w = weights.select(F.col("symbol").alias("a"), F.col("weight").alias("wa"))
    v = weights.select(F.col("symbol").alias("b"), F.col("weight").alias("wb"))
    j = cov.join(w, "a").join(v, "b")
    own = F.col("a") == F.col("b")
    g = j.agg(F.sum(F.when(own, F.abs("wa") * F.sqrt("cov"))).alias("whole"), F.sqrt(F.sum(F.col("cov") * F.col("wa") * F.col("wb"))).alias("portfolio"), F.sum(F.when(own, F.col("wa") * F.col("wa"))).alias("squares"), F.sum(F.when(own, F.abs("wa"))).alias("gross"))
    return g.select(F.try_divide("whole", "portfolio").alias("diversification_ratio"), F.try_divide(F.col("gross") * F.col("gross"), F.col("squares")).alias("effective_bets"), F.col("portfolio").alias("volatility"))


def correlation_summary(corr: DataFrame) -> DataFrame:
    """corr: (a, b, corr). Upper triangle: mean, median, spread, extremes, shares over 0.5 and 0.7."""
    u = corr.where("a < b")
    c = F.col("corr")
    return u.agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.stddev_samp(c).alias("sd"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(F.when(c > 0.5, 1.0).otherwise(0.0)).alias("over_50"), F.avg(F.when(c > 0.7, 1.0).otherwise(0.0)).alias("over_70"))


def order_flow_levels(events: DataFrame) -> DataFrame:
    """events: (symbol, side, price, ts, seq, delta). Total of each level after each order event (L3 to L2)."""
    w = Window.partitionBy("symbol", "side", "price").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("level_size", F.sum("delta").over(w))
