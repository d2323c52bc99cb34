"""Unit roots and stationarity by series: lag-augmented regressions, long-run variances, and the least difference that is stationary."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import regression as L
from tapewright.functions.staging import checkpointed
from tapewright.operators.microstructure import pair_spreads
from tapewright.operators.statistics import fractional_weights

#: The 5 % points of the unit-root t with a constant, of the residuals of a pair, and of the KPSS statistic.
UNIT_ROOT_5, PAIR_5, KPSS_5 = -2.86, -3.34, 0.463


def augmented_terms(x: Column, w, lags: int) -> list[Column]:
    """1, the level before, the `lags` changes before, and the change, of x in the order of window w."""
    d = [F.lag(x, k).over(w) - F.lag(x, k + 1).over(w) if k else x - F.lag(x, 1).over(w) for k in range(lags + 1)]
    return [F.lit(1.0), F.lag(x, 1).over(w), *d[1:], d[0]]


def unit_root(df: DataFrame, x: str, by: list[str], order: str = "ts", lags: int = 5) -> DataFrame:
    """(by, n, lags, t): t value of the level in the regression of the change on it, a constant and earlier changes.

    The number of earlier changes is the one, up to `lags`, with the least information criterion on the
    rows that have all of them. One aggregate a series: a step on each further change gives the next
    regression. Null if a series has too few rows or doesn't vary. Nulls in x are left out before.
    """
    w = Window.partitionBy(*by).orderBy(order)
    m = lags + 3
    names = [f"_v{k}" for k in range(m)]
    rows = df.where(F.col(x).isNotNull()).select(*by, *[c.alias(v) for c, v in zip(augmented_terms(F.col(x).cast("double"), w, lags), names, strict=True)])
    rows = rows.where(F.col(f"_v{lags + 1}").isNotNull() & F.col("_v1").isNotNull())
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), L.products([F.col(v) for v in names]).alias("_a"))
    g = g.withColumn("_a", L.solved(F.col("_a"), m, 2))
    fits = []
    for q in range(lags + 1):
        a = F.col(f"_a{q}") if q else F.col("_a")
        if q:
            g = g.withColumn(f"_a{q}", L.exchanged(F.col(f"_a{q - 1}") if q > 1 else F.col("_a"), F.lit(q + 1), m))
        free = F.col("n") - (q + 2)
        squares = F.when(free > 0, L.cell(a, m - 1, m - 1, m))
        error = F.sqrt(F.when(squares > 0, F.try_divide(squares, free) * L.cell(a, 1, 1, m)))
        criterion = F.round(F.when(squares > 0, F.col("n") * F.ln(squares / F.col("n")) + 2 * (q + 2)), 6)
        fits.append(F.struct(criterion.alias("aic"), F.lit(q).cast("long").alias("lags"), F.try_divide(L.coefficient(a, 1, m), error).alias("t")))
    best = F.array_min(F.filter(F.array(*fits), lambda s: s["aic"].isNotNull()))
    return g.withColumn("_best", best).select(*by, "n", F.col("_best.lags").alias("lags"), F.col("_best.t").alias("t"))


def kpss(df: DataFrame, x: str, by: str = "symbol", order: str = "ts") -> DataFrame:
    """(by, n, lags, kpss, stationary): squared partial sums of the deviations from the mean over their long-run variance.

    The variance has Bartlett weights up to 12 (n / 100) ** (1 / 4) lags, rounded up. Those weighted
    covariances equal the mean square of sums over lags + 1 neighbouring deviations, so each partial sum
    meets the one lags + 1 rows before it, by a join on the place.
    """
    w = Window.partitionBy(by).orderBy(order)
    d = df.where(F.col(x).isNotNull()).withColumn("_i", F.row_number().over(w).cast("long"))
    g = d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("_mean"))
    g = g.withColumn("lags", F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.col("n") - 1).cast("long"))
    s = d.join(g, by).withColumn("_e", F.col(x) - F.col("_mean")).withColumn("_s", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.select(by, "n", "lags", "_i", "_s")
    before = s.select(F.col(by).alias("_by"), (F.col("_i") + F.col("lags") + 1).alias("_at"), F.col("_s").alias("_b"))
    j = s.join(before, (F.col(by) == F.col("_by")) & (F.col("_i") == F.col("_at")), "left")
    step = F.col("_s") - F.coalesce("_b", F.lit(0.0))
    tail = F.when(F.col("_i") >= F.col("n") - F.col("lags"), F.when(F.col("_i") < F.col("n"), F.col("_s") * F.col("_s"))).otherwise(0.0)
    out = j.groupBy(by, "n", "lags").agg(F.sum(F.col("_s") * F.col("_s")).alias("_num"), (F.sum(step * step) + F.coalesce(F.sum(tail), F.lit(0.0))).alias("_var"))
    out = out.withColumn("kpss", F.try_divide(F.col("_num"), F.col("n") * F.try_divide(F.col("_var"), F.col("lags") + 1)))
    return out.select(by, "n", "lags", "kpss", (F.col("kpss") < KPSS_5).cast("long").alias("stationary"))


def fractional_grid(df: DataFrame, x: str, grid: list[float], threshold: float = 1e-5, most: int = 1000) -> DataFrame:
    """(symbol, ts, x, d, v): v is x differenced d times, with weights down to `threshold`; only where all weights have a value."""
    weights = [fractional_weights(d, threshold)[:most] for d in grid]
    last = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(max(map(len, weights)) - 1), 0)
    values = []
    for d, own in zip(grid, weights, strict=True):
        tail = F.slice(F.col("_past"), -len(own), len(own))
        total = F.aggregate(F.zip_with(tail, F.array(*[F.lit(float(v)) for v in reversed(own)]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        values.append(F.struct(F.lit(float(d)).alias("d"), F.when(F.size("_past") >= len(own), total).alias("v")))
    past = df.where(F.col(x).isNotNull()).select("symbol", "ts", F.col(x).cast("double").alias("x")).withColumn("_past", F.collect_list("x").over(last))
    return past.select("symbol", "ts", "x", F.inline(F.array(*values))).where("v is not null")


def minimum_difference(df: DataFrame, x: str = "close", steps: int = 20, threshold: float = 1e-5, lags: int = 5, least: int = 20) -> DataFrame:
    """(symbol, d, correlation, found): the smallest of `steps` orders from 0 to 1 whose difference passes the unit-root test at 5 %.

    correlation is that of the difference with x; without a passing order d is 1 and correlation 0. All
    orders of all series are tested at once.
    """
    long = fractional_grid(df, x, [k / (steps - 1) for k in range(steps)], threshold)
    tests = unit_root(long, "v", ["symbol", "d"], lags=lags)
    related = long.groupBy("symbol", "d").agg(F.corr("x", "v").alias("correlation"), F.count(F.lit(1)).alias("rows"))
    g = related.join(tests.select("symbol", "d", "t"), ["symbol", "d"], "left").where(F.col("rows") >= least)
    passing = F.col("t") < UNIT_ROOT_5
    out = g.groupBy("symbol").agg(F.min(F.when(passing, F.struct("d", "correlation"))).alias("_best"), F.count(F.lit(1)).alias("tested"))
    return out.select("symbol", F.coalesce(F.col("_best.d"), F.lit(1.0)).alias("d"), F.when(F.col("_best").isNull(), 0.0).otherwise(F.col("_best.correlation")).alias("correlation"), F.col("_best").isNotNull().cast("long").alias("found"), "tested")


def half_life(df: DataFrame, x: str, by: list[str], order: str = "ts") -> DataFrame:
    """(by, half_life): from the slope of the change on the level before; null unless x reverts."""
    before = F.lag(x).over(Window.partitionBy(*by).orderBy(order))
    rows = df.withColumn("_p", before).where("_p is not null")
    b = 1 + F.regr_slope(F.col(x) - F.col("_p"), F.col("_p"))
    return rows.groupBy(*by).agg(F.when((b > 0) & (b < 1), -math.log(2) / F.ln(b)).alias("half_life"))


def pair_tests(spreads: DataFrame, lags: int = 5) -> DataFrame:
    """(a, b, hedge, n, lags, t, cointegrated, half_life) of the residuals `spread` of every pair; the t is held against the 5 % point for residuals."""
    by = ["a", "b"]
    hedge = spreads.groupBy(*by).agg(F.first("hedge").alias("hedge"))
    out = hedge.join(unit_root(spreads, "spread", by, lags=lags), by, "left").join(half_life(spreads, "spread", by), by, "left")
    return out.withColumn("cointegrated", (F.coalesce(F.col("t"), F.lit(0.0)) < PAIR_5).cast("long"))


def projected_pairs(df: DataFrame, bands: int = 32, bits: int = 10, horizon: int = 1, seed: int = 0) -> DataFrame:
    """(a, b, shared) of symbols whose returns over `horizon` rows have like signs on all random directions of a band, or opposite ones on all.

    A direction is +1 or -1 for each time, drawn by a hash of it, so one aggregate of (symbol, band)
    gives all projections, without a pair. A return that a symbol lacks counts as its mean. Returns of
    correlation c agree on a direction with probability 1 - acos(c) / pi: at the defaults 0.97 of the
    pairs of correlation 0.8 are found, and 0.06 of the pairs of none. Closes of 0 or null give no return.
    """
    before = F.lag("close", horizon).over(Window.partitionBy("symbol").orderBy("ts"))
    rows = df.select("symbol", "ts", (F.try_divide(F.col("close"), before) - 1).alias("r")).where("r is not null")
    rows = rows.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    rows = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "band", F.col("ts").cast("long"))))
    signs = [F.when(F.substring("_h", k + 1, 1) < "8", 1.0).otherwise(-1.0) for k in range(bits)]
    sums = [c for k, sign in enumerate(signs) for c in (F.sum(sign * F.col("r")).alias(f"_p{k}"), F.sum(sign).alias(f"_s{k}"))]
    g = rows.groupBy("symbol", "band").agg(F.avg("r").alias("_m"), *sums)
    over = [(F.col(f"_p{k}") > F.col("_m") * F.col(f"_s{k}")).cast("int") for k in range(bits)]
    word = F.concat(*[(v != over[0]).cast("int").cast("string") for v in over[1:]])  # opposite signs give one word
    words = checkpointed(g.select("symbol", "band", word.alias("word")))
    one, other = words.withColumnRenamed("symbol", "a"), words.withColumnRenamed("symbol", "b")
    return one.join(other, ["band", "word"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def chosen_spreads(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ts, hedge, spread) of the given pairs (a, b): residuals of a's closes on b's, by least squares over their common times."""
    s = df.select("symbol", "ts", "close")
    p = pairs.select("a", "b").join(s.select(F.col("symbol").alias("a"), "ts", F.col("close").alias("y")), "a")
    p = p.join(s.select(F.col("symbol").alias("b"), "ts", F.col("close").alias("x")), ["b", "ts"])
    hedge = p.groupBy("a", "b").agg(F.regr_slope("y", "x").alias("hedge"))
    p = p.join(hedge, ["a", "b"])
    return p.select("a", "b", "ts", "hedge", (F.col("y") - F.col("hedge") * F.col("x")).alias("spread"))


def pair_search(df: DataFrame, pairs: DataFrame | None = None, shortest: float = 1.0, longest: float = 252.0, lags: int = 5) -> DataFrame:
    """pair_tests of the cointegrated pairs whose half-life is null or between `shortest` and `longest`.

    Without `pairs` all pairs of symbols are tested, which grows with the square of their number; with
    those of projected_pairs only pairs whose returns move together or against one another are.
    """
    life = F.col("half_life")
    spreads = pair_spreads(df) if pairs is None else chosen_spreads(df, pairs)
    tested = checkpointed(pair_tests(spreads, lags))  # one row a pair; a filter mustn't be pushed into the regressions' steps
    return tested.where((F.col("cointegrated") == 1) & (life.isNull() | life.between(shortest, longest)))


def total_least_squares(pairs: DataFrame) -> DataFrame:
    """(a, b, hedge, mean, sd) of (a, b, y, x): the hedge ratio that minimises distances at right angles, and its spread's moments."""
    g = pairs.groupBy("a", "b").agg(F.var_pop("y").alias("_yy"), F.var_pop("x").alias("_xx"), F.covar_pop("y", "x").alias("_xy"))
    d = F.col("_yy") - F.col("_xx")
    g = g.select("a", "b", F.try_divide(d + F.sqrt(d * d + 4 * F.col("_xy") * F.col("_xy")), 2 * F.col("_xy")).alias("hedge"))
    spread = F.col("y") - F.col("hedge") * F.col("x")
    return pairs.join(g, ["a", "b"]).groupBy("a", "b").agg(F.first("hedge").alias("hedge"), F.avg(spread).alias("mean"), F.stddev_samp(spread).alias("sd"))
