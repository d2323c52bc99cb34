"""Regime tables, snapshots and inference on returns, signal combination, and splits."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R

EULER = 0.5772156649015329


def direction(df: DataFrame, n: int = 5) -> DataFrame:
    """state: 'up' where the mean of the last n returns is positive, else 'down'."""
    return df.withColumn("state", F.when(R.mean("r", n, least=1) > 0, "up").otherwise("down"))


def regime_statistics(df: DataFrame, least: int = 1) -> DataFrame:
    """By symbol and state: rows, share of the symbol's rows, mean, deviation, Sharpe, compounded return and share of gains."""
    g = df.groupBy("symbol", "state").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.expm1(F.sum(F.log1p(F.greatest(F.col("r"), F.lit(-1 + 1e-6))))).alias("total_return"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"),
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))
    return g.withColumns({"share": share, "sharpe": F.try_divide("mean", "sd") * math.sqrt(252)}).where(F.col("n") >= least)


def regime_durations(df: DataFrame) -> DataFrame:
    """Number and mean length of the runs of each state."""
    runs = df.withColumn("run", R.islands("state")).groupBy("symbol", "run", "state").agg(F.count(F.lit(1)).alias("length"))
    return runs.groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("runs"), F.avg("length").alias("mean_length"))


def transitions(df: DataFrame) -> DataFrame:
    """Share of each next state among a state's successors; `expected` is the expected stay of a state that follows itself."""
    g = df.withColumn("after", R.lead("state")).where("after is not null").groupBy("symbol", "state", "after").agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "state")))
    return g.withColumn("expected", F.when((F.col("state") == F.col("after")) & (F.col("p") < 1), 1 / (1 - F.col("p"))))


def regime_age(df: DataFrame) -> DataFrame:
    """changed: 1 where the state differs from the row before; age: rows since then."""
    x = df.withColumns({"run": R.islands("state"), "changed": F.coalesce((F.col("state") != R.lag("state")).cast("long"), F.lit(0))})
    return x.withColumn("age", (F.row_number().over(Window.partitionBy("symbol", "run").orderBy("ts")) - 1).cast("long"))


def snapshot_risk(df: DataFrame, share: float = 0.05, z: float = 1.645) -> DataFrame:
    """Historical and parametric value at risk, and the mean of the returns at or under the historical one."""
    v = df.groupBy("symbol").agg((-F.percentile("r", F.lit(share))).alias("var"), (z * F.stddev_pop("r") - F.avg("r")).alias("var_normal"))
    return df.join(v, "symbol").groupBy("symbol").agg(F.first("var").alias("var"), F.first("var_normal").alias("var_normal"), F.avg(F.when(F.col("r") <= -F.col("var"), F.col("r"))).alias("cvar"))


def sharpe_test(df: DataFrame, trials: int = 10, periods: int = 252) -> DataFrame:
    """The Sharpe ratio against zero with an error that allows for skew, tails and lag-1 correlation, and against the best of `trials` ratios without skill."""
    d = df.withColumn("before", R.lag("r"))
    g = d.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurt"), F.corr("r", "before").alias("rho"))
    normal = NormalDist().inv_cdf
    best = (1 - EULER) * normal(1 - 1 / trials) + EULER * normal(1 - 1 / (trials * math.e))
    s, k, n = F.col("sharpe"), F.col("kurt"), F.col("n")
    per = F.col("m") / F.col("sd")
    error = F.sqrt((1 + 0.5 * s * s - F.col("skew") * s + k / 4 * s * s) / n) * math.sqrt(periods) * F.sqrt((1 + 2 * F.col("rho")) / (1 - F.col("rho")))
    return g.withColumn("sharpe", per * math.sqrt(periods)).withColumns({"t": s / error, "deflated_z": (per - best) / F.sqrt((1 - F.col("skew") * per + (k + 2) / 4 * per * per) / (n - 1))})


def period_to_date(df: DataFrame) -> DataFrame:
    """Compounded return since the start of the month, quarter and year of each symbol's last row."""
    ends = df.groupBy("symbol").agg(F.max("ts").alias("end"))
    j = df.join(ends, "symbol")
    since = lambda unit: F.coalesce(F.expm1(F.sum(F.when(F.col("ts") >= F.date_trunc(unit, "end"), F.log1p(F.greatest(F.col("r"), F.lit(-1 + 1e-6)))))), F.lit(0.0))
    return j.groupBy("symbol").agg(since("month").alias("mtd"), since("quarter").alias("qtd"), since("year").alias("ytd"), since("week").alias("wtd"))


def depth_histogram(df: DataFrame, edges: tuple[float, ...] = (0, 2, 5, 10, 15, 20, 30, 50, 100)) -> DataFrame:
    """Rows under water by depth in percent; a bin holds its upper edge."""
    depth = 100 * (1 - F.col("close") / R.running(F.max, "close"))
    name = F.lit(None).cast("string")
    for a, b in zip(edges[:-1], edges[1:]):
        name = F.when((F.col("depth") > a) & (F.col("depth") <= b), f"{a}-{b}").otherwise(name)
    return df.withColumn("depth", depth).withColumn("bin", name).where("bin is not null").groupBy("symbol", "bin").agg(F.count(F.lit(1)).alias("n"))


def drawdown_alert(df: DataFrame) -> DataFrame:
    """The latest drawdown of each symbol and how bad it is."""
    d = df.withColumn("dd", F.col("close") / R.running(F.max, "close") - 1).groupBy("symbol").agg(F.max_by("dd", "ts").alias("dd"))
    return d.withColumn("alert", F.when(F.col("dd") < -0.2, "critical").when(F.col("dd") < -0.1, "warning").otherwise("ok"))


def fold_metrics(df: DataFrame, folds: int = 5) -> DataFrame:
    """Sharpe and mean return of equal parts of each symbol's time."""
    x = df.withColumn("fold", F.ntile(folds).over(R.W))
    return x.groupBy("symbol", "fold").agg((F.avg("r") / F.stddev_samp("r") * math.sqrt(252)).alias("sharpe"), (F.avg("r") * 252).alias("mean"))


def metric_summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation, least, most and median over folds, a row per metric."""
    long = metrics.unpivot(["symbol", "fold"], columns, "metric", "v")
    return long.groupBy("symbol", "metric").agg(F.avg("v").alias("avg"), F.stddev_samp("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile("v", F.lit(0.5)).alias("median"))


def stability(metrics: DataFrame, x: str = "sharpe") -> DataFrame:
    return metrics.groupBy("symbol").agg(F.try_divide(F.avg(x), F.stddev_pop(x)).alias("ratio"), F.avg((F.col(x) > 0).cast("double")).alias("positive_share"))


def degradation(metrics: DataFrame, x: str = "sharpe") -> DataFrame:
    """How far the last fold's metric is under the first one's, as a share of it."""
    last = F.max_by(x, "fold")
    g = metrics.groupBy("symbol").agg(F.min_by(x, "fold").alias("base"), last.alias("now"))
    drop = F.try_divide(F.col("base") - F.col("now"), F.abs("base"))
    return g.withColumn("drop", drop).withColumn("alert", F.when(drop >= 0.2, "critical").when(drop > 0.1, "warning").otherwise("ok"))


def information(df: DataFrame, signal: str, target: str) -> DataFrame:
    """By time: rank correlation of signal and target, squared error, and share of equal signs."""
    x = df.where(F.col(signal).isNotNull() & F.col(target).isNotNull())
    x = x.withColumns({"a": R.average_rank(signal, "ts"), "b": R.average_rank(target, "ts")})
    s, t = F.col(signal), F.col(target)
    return x.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("ic"), F.avg((s - t) * (s - t)).alias("mse"), F.avg((F.signum(s) == F.signum(t)).cast("double")).alias("direction"))


def rank_correlation(df: DataFrame, a: str, b: str, by: str = "symbol") -> DataFrame:
    x = df.withColumns({"ra": R.average_rank(a, by), "rb": R.average_rank(b, by)})
    return x.groupBy(by).agg(F.corr(a, b).alias("pearson"), F.corr("ra", "rb").alias("spearman"))


def sector_correlations(df: DataFrame, least: int = 3) -> DataFrame:
    """Correlation of the sectors' mean returns, for each pair of sectors; one row per time and sector is joined on time."""
    m = df.where("r is not null").groupBy("ts", "sector").agg(F.avg("r").alias("r"))
    b = m.select("ts", F.col("sector").alias("other"), F.col("r").alias("q"))
    return m.join(b, "ts").where("sector < other").groupBy("sector", "other").agg(F.count(F.lit(1)).alias("n"), F.corr("r", "q").alias("corr")).where(F.col("n") >= least)


def half_life(df: DataFrame, x: str = "close") -> DataFrame:
    """Half-life of the first-order autoregression; infinite unless its slope is within 0 and 1."""
    g = df.withColumn("before", R.lag(x)).groupBy("symbol").agg(F.regr_slope(F.col(x), F.col("before")).alias("slope"))
    b = F.col("slope")
    return g.withColumn("half_life", F.when((b > 0) & (b < 1), -math.log(2) / F.ln(b)).otherwise(float("inf")))


def rolling_metrics(df: DataFrame, n: int = 60) -> DataFrame:
    mean, sd = R.mean("r", n), R.std("r", n)
    return df.withColumns({"rolling_return": mean * 252, "rolling_volatility": sd * math.sqrt(252), "rolling_sharpe": F.try_divide(mean, sd) * math.sqrt(252), "rolling_var": -R.roll(lambda c: F.percentile(c, F.lit(0.05)), "r", n)})


def rank_average(long: DataFrame) -> DataFrame:
    """Mean over strategies of the signals' percentile ranks less a half."""
    w = Window.partitionBy("strategy", "ts")
    x = long.where("signal is not null").withColumn("p", R.average_rank("signal", "strategy", "ts") / F.count("signal").over(w) - 0.5)
    return x.groupBy("symbol", "ts").agg(F.avg("p").alias("rank_average"))


def contribution(long: DataFrame, weights: dict[str, float]) -> DataFrame:
    names = F.create_map(*[F.lit(z) for kv in weights.items() for z in kv])
    s = F.col("signal")
    g = long.groupBy("strategy").agg(F.avg(s).alias("mean"), F.stddev_samp(s).alias("sd"), *[(100 * F.avg(c.cast("double"))).alias(n) for n, c in {"long_pct": s > 0, "short_pct": s < 0, "neutral_pct": s == 0}.items()])
    return g.withColumn("weight", F.coalesce(names[F.col("strategy")], F.lit(0.0)))


def scored_signals(df: DataFrame, p: str, n: int = 5, cut: float = 0.6) -> DataFrame:
    """1 for a time's n best scores over `cut`, -1 for its n worst under 1 - `cut`, else 0."""
    w = Window.partitionBy("ts")
    x = df.where(F.col(p).isNotNull()).withColumns({"best": F.row_number().over(w.orderBy(F.desc(p), "symbol")), "worst": F.row_number().over(w.orderBy(p, "symbol"))})
    return x.withColumn("signal", F.when((F.col("best") <= n) & (F.col(p) > cut), 1.0).when((F.col("worst") <= n) & (F.col(p) < 1 - cut), -1.0).otherwise(0.0))


def share_of(df: DataFrame, share: float = 0.7) -> Column:
    """1 for the first `share` of a symbol's rows, else 0."""
    return (F.row_number().over(R.W) <= F.floor(share * F.count(F.lit(1)).over(Window.partitionBy("symbol")))).cast("long")


def combinatorial_folds(df: DataFrame, blocks: int = 5, tests: int = 2, purge: int = 3, embargo: int = 3) -> DataFrame:
    """All choices of test blocks: rows used for training (not within `purge` before or `embargo` after a test block) and for testing."""
    x = df.withColumns({"i": F.row_number().over(R.W) - 1, "block": F.ntile(blocks).over(R.W) - 1})
    bounds = x.groupBy("symbol", "block").agg(F.min("i").alias("a"), F.max("i").alias("b")).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("block", "a", "b"))).alias("bounds"))
    combos = F.array(*[F.struct(F.lit(k).cast("long").alias("combo"), F.array(*map(F.lit, c)).alias("chosen")) for k, c in enumerate(itertools.combinations(range(blocks), tests))])
    j = x.join(bounds, "symbol").select("i", "block", "bounds", "symbol", F.inline(combos))  # a row for each choice, by definition
    near = F.exists("bounds", lambda s: F.array_contains("chosen", s["block"]) & (F.col("i") >= s["a"] - purge) & (F.col("i") <= s["b"] + embargo))
    test = F.array_contains("chosen", F.col("block"))
    return j.groupBy("symbol", "combo").agg(F.count_if(test).alias("n_test"), F.count_if(~near).alias("n_train"))


def group_split(df: DataFrame, train: float = 0.7, validation: float = 0.15, purge: int = 5, embargo: int = 3) -> DataFrame:
    """Each symbol's rows in time order as train, validation and test, without `purge` rows before and `embargo` rows after each cut."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    x = df.withColumns({"i": F.row_number().over(R.W) - 1, "a": F.floor(train * n), "b": F.floor((train + validation) * n)})
    i, a, b = F.col("i"), F.col("a"), F.col("b")
    return x.withColumn("role", F.when(i < a - purge, "train").when(i < a + embargo, "none").when(i < b - purge, "validation").when(i < b + embargo, "none").otherwise("test"))


def combined_curves(curves: DataFrame) -> DataFrame:
    """(curve, symbol, ts, value): each curve starts at one; at a time in several curves the first curve counts."""
    first = F.first_value("value").over(Window.partitionBy("curve", "symbol").orderBy("ts"))
    x = curves.withColumn("equity", F.col("value") / first)
    return x.groupBy("symbol", "ts").agg(F.min_by("equity", "curve").alias("equity"))


def rolling_apply(df: DataFrame, x: str, n: int, f, name: str) -> DataFrame:
    """f, any function from a pandas Series to a number, over the last n values; null until there are n. Windows reach Python in Arrow batches."""
    g = F.pandas_udf(f, "double")
    frame = R.series().rowsBetween(-(n - 1), 0)
    return df.withColumn(name, F.when(F.count(x).over(frame) >= n, g(F.col(x)).over(frame)))


def crossover_scores(df: DataFrame, params: tuple[int, ...], folds: int = 4) -> DataFrame:
    """Score of each parameter in each part of the time: sum of returns times the sign of the last close over its mean of `param` rows."""
    x = df.withColumn("r", R.pct("close"))
    x = x.withColumns({str(p): R.lag(F.signum(F.col("close") - R.mean("close", p))) * F.col("r") for p in params}).withColumn("fold", F.ntile(folds).over(R.W))
    long = x.select("symbol", "fold", F.inline(F.array(*[F.struct(F.lit(p).cast("long").alias("param"), F.col(str(p)).alias("v")) for p in params])))
    return long.groupBy("symbol", "fold", "param").agg(F.round(F.sum("v"), 9).alias("score"))


def walk_forward_search(scores: DataFrame) -> DataFrame:
    """The best parameter of each part, smaller ones first among equals, and its score in the next part."""
    best = scores.groupBy("symbol", "fold").agg(F.max_by("param", F.struct("score", -F.col("param"))).alias("param"), F.max("score").alias("train_score"))
    later = scores.select("symbol", (F.col("fold") - 1).alias("fold"), "param", F.col("score").alias("test_score"))
    return best.join(later, ["symbol", "fold", "param"])
