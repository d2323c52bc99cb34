"""Resampling on Spark: every draw is a hash of (seed, path, block), so reruns and any partitioning agree."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R


def draw(seed: int, *on):
    """A hash of the columns, 0 or more, that SQL can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *on)), 1, 8), 16, 10).cast("long")


def block_paths(returns: DataFrame, paths: int, block: int, seed: int = 7) -> DataFrame:
    """returns: (symbol, i, r), i from 0. (symbol, path, k, r): blocks at drawn starts put together to each series' length.

    Drawn places join the returns on (symbol, i); paths x length rows of a series, dealt over all tasks.
    Series shorter than a block have no paths.
    """
    n = returns.groupBy("symbol").agg(F.count(F.lit(1)).cast("long").alias("n")).where(F.col("n") >= block)
    starts = n.withColumn("path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(paths - 1).cast("long")))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n + {block - 1}) div {block} - 1"))))
    starts = starts.withColumn("s", draw(seed, "symbol", "path", "b") % (F.col("n") - block + 1))
    at = starts.select("symbol", "path", "b", "s", "n", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("j"))
    at = at.select("symbol", "path", (F.col("b") * block + F.col("j")).alias("k"), (F.col("s") + F.col("j")).alias("i"), "n").where("k < n")
    return at.join(returns, ["symbol", "i"]).select("symbol", "path", "k", "r")


def path_metrics(p: DataFrame) -> DataFrame:
    """Per path: total return, Sharpe ratio and largest drawdown."""
    w = Window.partitionBy("symbol", "path").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("e", F.exp(F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-6)))).over(w)))
    p = p.withColumn("dd", F.col("e") / F.greatest(F.max("e").over(w), F.lit(1.0)) - 1)
    return p.groupBy("symbol", "path").agg((F.max_by("e", "k") - 1).alias("total_return"), F.try_divide(F.avg("r"), F.stddev_samp("r")).alias("sharpe"), F.min("dd").alias("max_drawdown"))


def intervals(m: DataFrame, column: str, shares: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    p = F.percentile(column, F.array(*map(F.lit, shares)))
    return m.groupBy("symbol").agg(*[F.get(p, F.lit(i)).alias(f"p{int(100 * q):02d}") for i, q in enumerate(shares)], F.avg(column).alias("mean"), F.avg(F.when(F.col(column) < 0, 1.0).otherwise(0.0)).alias("loss_share"))


def sign_flips(returns: DataFrame, paths: int, seed: int = 7) -> DataFrame:
    """Sign-flip test by symbol: share of paths with drawn signs whose mean reaches the observed one."""
    x = returns.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    m = x.withColumn("f", F.when(draw(seed, "symbol", "path", "i") % 2 == 0, F.col("r")).otherwise(-F.col("r"))).groupBy("symbol", "path").agg(F.avg("f").alias("m"))
    seen = returns.groupBy("symbol").agg(F.avg("r").alias("seen"))
    hits = F.sum(F.when(F.round("m", 12) >= F.round("seen", 12), 1).otherwise(0)) + 1
    return m.join(seen, "symbol").groupBy("symbol").agg(hits.alias("hits"), F.count(F.lit(1)).alias("n")).withColumn("p_value", F.col("hits") / (F.col("n") + 1))


def backtest_overfitting(long: DataFrame, blocks: int = 16) -> DataFrame:
    """long: (strategy, i, r). Share of block combinations in which the best strategy in sample is not the best outside; mean and deviation of the rank correlations of both.

    Only (n, sum, sum of squares) of each strategy and block are kept; combinations meet those.
    """
    length = long.agg((F.max("i") + 1).alias("n"))  # one row
    s = long.crossJoin(F.broadcast(length)).withColumn("block", F.floor(F.col("i") * blocks / F.col("n"))).groupBy("strategy", "block").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    combos = [(k, b, int(b in c)) for k, c in enumerate(itertools.combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    c = long.sparkSession.createDataFrame(combos, "combo long, block long, inside int")
    g = s.join(c, "block").groupBy("combo", "strategy", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    sharpe = F.round(F.try_divide(mean, F.sqrt((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1))), 10)
    g = g.withColumn("sharpe", sharpe)
    # One row per strategy is ranked in a combination.
    sides = g.groupBy("combo", "strategy").agg(*[F.max(F.when(F.col("inside") == k, F.col("sharpe"))).alias(n) for k, n in ((1, "x"), (0, "y"))]).where("x is not null and y is not null")
    ranked = sides.withColumns({"rx": R.average_rank("x", "combo"), "ry": R.average_rank("y", "combo")})
    rho = ranked.groupBy("combo").agg(F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")).alias("rho")).agg(F.avg("rho").alias("mean_correlation"), F.stddev_pop("rho").alias("sd_correlation"))
    best = g.groupBy("combo", "inside").agg(F.max_by("strategy", F.struct("sharpe", "strategy")).alias("best"))
    w = best.groupBy("combo").agg(F.max(F.when(F.col("inside") == 1, F.col("best"))).alias("a"), F.max(F.when(F.col("inside") == 0, F.col("best"))).alias("b"))
    return w.agg(F.avg(F.when(F.col("a") != F.col("b"), 1.0).otherwise(0.0)).alias("pbo"), F.count(F.lit(1)).alias("n_combos")).crossJoin(F.broadcast(rho))  # a row each
