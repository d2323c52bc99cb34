"""Execution costs and position sizes as column expressions; a side is +1 for a buy and -1 for a sale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def shifted(price: Column, side: Column, bps: Column) -> Column:
    """Price after a cost in basis points against the trader."""
    return price * (1 + side * bps / 10_000)


def simple_fill(price: Column, side: Column, bps: float) -> Column:
    """Dearer by bps for a buy; divided by the same factor for a sale."""
    return F.when(side > 0, price * (1 + bps / 10_000)).otherwise(price / (1 + bps / 10_000))


def limit_reached(fill: Column, side: Column, limit: Column) -> Column:
    return F.when(side > 0, fill <= limit).otherwise(fill >= limit)


def impact(quantity: Column, days: float, adv: Column, eta: float = 0.1, gamma: float = 0.05) -> tuple[Column, Column]:
    """Temporary and permanent impact in basis points; both are linear, the first in the rate of execution."""
    return 10_000 * eta * (quantity / days) / adv, 10_000 * gamma * quantity / adv


def impact_cost(quantity: Column, days: float, adv: Column, sigma: Column, eta: float = 0.1, gamma: float = 0.05) -> tuple[Column, Column]:
    """Expected cost of an execution over `days` as a fraction of the value, and its variance."""
    temporary, permanent = impact(quantity, days, adv, eta, gamma)
    return (permanent + temporary * days) / 10_000, F.pow(sigma * quantity, F.lit(2)) * days / 3


def spread(volatility: Column, volume_ratio: Column, base: float = 5.0, floor: float = 1.0, most: float = 50.0, sensitivity: tuple[float, float] = (1.0, 0.5), hour: Column | None = None, busy: dict[int, float] | None = None) -> Column:
    """Spread in basis points: wider when volatile or quiet, at some hours, and inside bounds."""
    by_vol = F.greatest(F.lit(0.5), 1 + sensitivity[0] * (volatility / 0.02 - 1))
    by_volume = F.when(volume_ratio > 0, F.greatest(F.lit(0.5), 1 + sensitivity[1] * (1 / volume_ratio - 1))).otherwise(1.0)
    x = base * by_vol * by_volume
    if hour is not None and busy:
        by_hour = F.lit(1.0)
        for h, factor in busy.items():
            by_hour = F.when(hour == h, factor).otherwise(by_hour)
        x = x * by_hour
    return clip(x, floor, most)


def capped_impact(value: Column, adv: Column, volatility: Column, most: float = 0.2) -> Column:
    """Square root of the share of volume, times volatility, at most `most`; that much if there is no volume."""
    return F.when(adv <= 0, most).otherwise(F.least(volatility * F.sqrt(value / adv), F.lit(most)))


def volatility_scaled(base: Column, current: Column, target: float = 0.15, most: float = 1.0) -> Column:
    """Size scaled by target over current volatility, the factor within 0.25 and 2; as it is without volatility."""
    return F.when(current <= 0, base).otherwise(clip(base * clip(target / current, 0.25, 2.0), -most, most))


def bet_size(p: Column, side: Column, least: float = 0.55, most: float = 1.0) -> Column:
    """Size from the probability that the bet is right: nothing under `least`, else its edge over the odds of a coin."""
    return F.when(p >= least, clip(2 * p - 1, 0.0, 1.0) * most * side).otherwise(0.0)


def target_size(capital: float, target: float, volatility: Column) -> Column:
    return F.when(volatility > 0, capital * target / volatility).otherwise(0.0)


def rebalance_threshold(volatility: Column, mean_spread: Column, base: float = 0.05) -> Column:
    """Threshold that rises with volatility over 15 % and with the spread."""
    return base * clip(1 + (volatility - 0.15) / 0.15, 0.5, 2.0) * (1 + 100 * mean_spread)


def without_small_trades(df: DataFrame, least: float = 0.01, by: str = "ts") -> DataFrame:
    """(ts, symbol, current, target): the target where it is far enough from the current weight; `weight` has an absolute sum of one at each time."""
    df = df.withColumn("kept", F.when(F.abs(F.col("target") - F.col("current")) >= least, F.col("target")).otherwise(F.col("current")))
    gross = df.groupBy(by).agg(F.sum(F.abs("kept")).alias("gross"))
    return df.join(gross, by).withColumn("weight", F.when(F.col("gross") > 0, F.col("kept") / F.col("gross")).otherwise(F.col("kept")))


def drift(current: DataFrame, target: DataFrame, least: float = 0.001) -> DataFrame:
    """(ts, symbol, weight) twice: what to trade to get from one to the other; a missing weight is zero."""
    j = current.withColumnRenamed("weight", "current").join(target.withColumnRenamed("weight", "target"), ["ts", "symbol"], "full_outer").fillna(0.0, ["current", "target"])
    d = F.col("target") - F.col("current")
    return j.withColumn("drift", d).withColumn("trade", F.when(d > least, "buy").when(d < -least, "sell").otherwise("hold"))
