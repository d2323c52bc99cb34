"""Performance, risk, drift and validation statistics: aggregates over returns, predictions and features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R

PERIODS = 252


def total_return(r: str = "r") -> Column:
    return F.exp(F.sum(F.ln(F.greatest(1 + F.col(r), F.lit(1e-6))))) - 1


def performance(df: DataFrame, by: str = "symbol", periods: int = PERIODS, rf: float = 0.05) -> DataFrame:
    """df: (by, ts, r). Return, risk-adjusted and tail measures of each group, in one aggregation after one window."""
    w = Window.partitionBy(by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_e", F.exp(F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-6)))).over(w)))
    df = df.withColumn("_dd", F.col("_e") / F.greatest(F.max("_e").over(w), F.lit(1.0)) - 1)
    r = F.col("r")
    ex = F.avg(r) - rf / periods
    g = df.groupBy(by).agg(
        F.count("r").alias("n"), total_return().alias("total_return"), (F.avg(r) * periods).alias("annual_return"), (F.stddev_samp(r) * math.sqrt(periods)).alias("annual_volatility"),
        (F.try_divide(ex, F.stddev_samp(r)) * math.sqrt(periods)).alias("sharpe"), (F.try_divide(ex, F.stddev_samp(F.when(r < 0, r))) * math.sqrt(periods)).alias("sortino"),
        F.min("_dd").alias("max_drawdown"), F.avg("_dd").alias("avg_drawdown"), F.max(r).alias("best"), F.min(r).alias("worst"),
        F.abs(F.percentile(r, F.lit(0.05))).alias("var_95"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt"),
        F.try_divide(F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))).alias("omega"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("positive_share"),
    )
    return g.withColumn("calmar", F.try_divide(F.col("annual_return"), -F.col("max_drawdown")))


def benchmark(df: DataFrame, by: str = "symbol", periods: int = PERIODS, rf: float = 0.05) -> DataFrame:
    """df: (by, r, m). Beta, alpha, information ratio, Treynor and correlation against the benchmark m."""
    a = F.col("r") - F.col("m")
    g = df.groupBy(by).agg(
        F.try_divide(F.covar_samp("r", "m"), F.var_samp("m")).alias("beta"), F.avg("r").alias("_r"), F.avg("m").alias("_m"),
        (F.try_divide(F.avg(a), F.stddev_samp(a)) * math.sqrt(periods)).alias("information_ratio"), F.try_divide(F.covar_samp("r", "m"), F.stddev_samp("r") * F.stddev_samp("m")).alias("correlation"),
    )
    f = rf / periods
    alpha = (F.col("_r") - f - F.col("beta") * (F.col("_m") - f)) * periods
    return g.withColumns({"alpha": alpha, "treynor": F.try_divide((F.col("_r") - f) * periods, F.col("beta"))}).drop("_r", "_m")


def value_at_risk(df: DataFrame, by: str = "symbol", confidence: float = 0.95, z: float = -1.6448536269514722) -> DataFrame:
    """Historical and parametric VaR, and the mean return at or below each."""
    v = df.groupBy(by).agg(F.percentile("r", F.lit(1 - confidence)).alias("historical_var"), (F.avg("r") + z * F.stddev_samp("r")).alias("parametric_var"))
    j = df.join(v, by)
    return j.groupBy(by).agg(
        F.first("historical_var").alias("historical_var"), F.first("parametric_var").alias("parametric_var"),
        F.avg(F.when(F.col("r") <= F.col("historical_var"), F.col("r"))).alias("cvar"), F.avg(F.when(F.col("r") <= F.col("parametric_var"), F.col("r"))).alias("parametric_cvar"),
    )


def monthly(df: DataFrame, by: str = "symbol") -> DataFrame:
    return df.groupBy(by, F.date_trunc("month", "ts").alias("ts")).agg(total_return().alias("r"), F.count(F.lit(1)).alias("n"))


def streaks(df: DataFrame, by: str = "symbol") -> DataFrame:
    """Win rate, profit factor, payoff, expectancy and the longest runs of wins and losses."""
    w = Window.partitionBy(by).orderBy("ts")
    s = df.withColumn("_s", F.signum("r")).withColumn("_run", R.islands("_s", w))
    runs = s.groupBy(by, "_run").agg(F.first("_s").alias("s"), F.count(F.lit(1)).alias("k"), F.sum("r").alias("t"))
    r = F.col("r")
    g = df.groupBy(by).agg(
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.try_divide(F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))).alias("profit_factor"),
        F.try_divide(F.avg(F.when(r > 0, r)), -F.avg(F.when(r < 0, r))).alias("payoff"), F.avg(r).alias("expectancy"),
    )
    k = runs.groupBy(by).agg(F.max(F.when(F.col("s") > 0, F.col("k")).otherwise(0)).alias("longest_win"), F.max(F.when(F.col("s") < 0, F.col("k")).otherwise(0)).alias("longest_loss"))
    return g.join(k, by)


def sharpe_inference(df: DataFrame, by: str = "symbol") -> DataFrame:
    """Sharpe ratio per period with its standard error (skew, kurtosis), probability of exceeding 0 as a z value, and minimum track record."""
    g = df.groupBy(by).agg(F.count("r").alias("n"), F.try_divide(F.avg("r"), F.stddev_samp("r")).alias("sr"), F.skewness("r").alias("g3"), F.kurtosis("r").alias("g4"))
    var = 1 - F.col("g3") * F.col("sr") + (F.col("g4") + 2) / 4 * F.col("sr") * F.col("sr")
    se = F.sqrt(var / (F.col("n") - 1))
    z95 = 1.6448536269514722
    return g.select(by, "n", "sr", se.alias("se"), F.try_divide(F.col("sr"), se).alias("psr_z"), (1 + var * F.pow(F.try_divide(F.lit(z95), F.col("sr")), F.lit(2))).alias("min_track_record"))


def hourly_profile(df: DataFrame) -> DataFrame:
    """Execution report by symbol, by hour and overall: grouping sets over (symbol, ts, shortfall, value)."""
    h = df.withColumn("hour", F.hour("ts"))
    return h.rollup("symbol", "hour").agg(F.count(F.lit(1)).alias("n"), F.avg("shortfall").alias("avg_shortfall"), F.sum("value").alias("value"), F.grouping_id().alias("level"))


def psi(ref: DataFrame, cur: DataFrame, bins: int = 10, eps: float = 1e-10) -> DataFrame:
    """Both: (feature, value). Population stability index on the reference's deciles; values outside drop out."""
    cuts = [i / bins for i in range(bins + 1)]
    edges = R.percentiles(ref, "value", tuple(cuts), ["feature"]).withColumnRenamed("q", "e")

    def shares(df, name):
        j = df.join(edges, "feature").where((F.col("value") >= F.get("e", F.lit(0))) & (F.col("value") <= F.get("e", F.lit(bins))))
        b = F.least(F.size(F.filter("e", lambda x: x <= F.col("value"))), F.lit(bins))
        n = j.groupBy("feature", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        return n.select("feature", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).alias(name))

    j = shares(ref, "p").join(shares(cur, "q"), ["feature", "bin"], "full_outer")
    p, q = F.coalesce("p", F.lit(0.0)) + eps, F.coalesce("q", F.lit(0.0)) + eps
    m = (p + q) / 2
    js = F.sqrt(F.sum(p * F.ln(p / m) + q * F.ln(q / m)) / 2)
    return j.groupBy("feature").agg(F.sum((q - p) * F.ln(q / p)).alias("psi"), js.alias("js"))


def ks(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """Both: (feature, value). Largest distance between the empirical distributions, by one union and running counts; null if one side lacks the feature."""
    u = ref.select("feature", "value", F.lit(1).alias("a"), F.lit(0).alias("b")).union(cur.select("feature", "value", F.lit(0), F.lit(1)))
    g = u.groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # Running counts within buckets of near values, on top of the counts of the buckets before.
    g = g.withColumn("bucket", R.order_bucket("value"))
    sums = g.groupBy("feature", "bucket").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    before, whole = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("feature")
    sums = sums.select("feature", "bucket", *[F.coalesce(F.sum(f"s{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in "ab"], *[F.sum(f"s{c}").over(whole).alias(f"all_{c}") for c in "ab"])
    w = Window.partitionBy("feature", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({f"run_{c}": F.sum(c).over(w) for c in "ab"}).join(sums, ["feature", "bucket"])
    share = lambda c: (F.col(f"before_{c}") + F.col(f"run_{c}")) / F.greatest(F.col(f"all_{c}"), F.lit(1))
    both = (F.col("all_a") > 0) & (F.col("all_b") > 0)
    ends = g.withColumn("d", F.when(both, F.abs(share("a") - share("b"))).otherwise(-1.0)).groupBy("feature").agg(F.max("d").alias("ks"), F.sum("a").alias("n_ref"), F.sum("b").alias("n_cur"))
    return ends.withColumn("ks", F.when(F.col("ks") >= 0, F.col("ks")))


def two_sample(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """By feature: Welch's t, the Mann-Whitney U with average ranks, the KS distance, and the differences of means and of mean over deviation a year of 15-minute bars."""
    distance = ks(ref, cur).select("feature", "ks")
    u = ref.select("feature", "value", F.lit("a").alias("side")).union(cur.select("feature", "value", F.lit("b")))
    u = R.spread_rank(u, "value", ["feature"], "rank")
    a, b = F.col("side") == "a", F.col("side") == "b"
    g = u.groupBy("feature").agg(
        *[f.alias(n) for n, f in (("na", F.sum(F.when(a, 1))), ("nb", F.sum(F.when(b, 1))), ("ma", F.avg(F.when(a, F.col("value")))), ("mb", F.avg(F.when(b, F.col("value")))), ("va", F.var_samp(F.when(a, F.col("value")))), ("vb", F.var_samp(F.when(b, F.col("value")))), ("ra", F.sum(F.when(a, F.col("rank")))))]
    )
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb")))
    ratio = F.try_divide("ma", F.sqrt("va")) - F.try_divide("mb", F.sqrt("vb"))
    g = g.select("feature", t.alias("t"), (F.col("ra") - F.col("na") * (F.col("na") + 1) / 2).alias("u"), (F.col("ma") - F.col("mb")).alias("mean_diff"), (ratio * math.sqrt(252 * 26)).alias("sharpe_diff"))
    return g.join(distance, "feature")


def reference_statistics(df: DataFrame) -> DataFrame:
    v = F.col("value")
    return df.groupBy("feature").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"), F.percentile(v, F.lit(0.5)).alias("median"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """df: (p, y). Reliability curve: per bin count, mean forecast and frequency; the last bin is closed."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("frequency"))


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    c = calibration(df, bins)
    e = c.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("frequency"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
    return e.crossJoin(df.agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("brier")))  # a row each


def classification(df: DataFrame, cut: float = 0.5) -> DataFrame:
    """df: (p, y). Accuracy, precision, recall, F1 and AUC by average ranks."""
    d = R.spread_rank(df, "p", [], "rank")
    hit = F.col("p") >= cut
    y = F.col("y") == 1
    s = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = d.agg(s(hit & y).alias("tp"), s(hit & ~y).alias("fp"), s(~hit & y).alias("fn"), s(~hit & ~y).alias("tn"), F.sum(F.when(y, F.col("rank"))).alias("rs"))
    pos, neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return g.select(
        ((F.col("tp") + F.col("tn")) / (pos + neg)).alias("accuracy"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), pos).alias("recall"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), F.try_divide(F.col("rs") - pos * (pos + 1) / 2, pos * neg).alias("auc"),
    )


def regression(df: DataFrame, by: str = "symbol") -> DataFrame:
    """df: (by, p, y). mse, mae, r2, direction accuracy and information coefficient (rank correlation)."""
    d = df.withColumns({"ry": R.average_rank("y", by), "rp": R.average_rank("p", by)})
    e = F.col("y") - F.col("p")
    return d.groupBy(by).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.avg(e * e), F.var_pop("y"))).alias("r2"),
        F.avg(F.when(F.signum("y") == F.signum("p"), 1.0).otherwise(0.0)).alias("direction"), F.try_divide(F.covar_pop("ry", "rp"), F.stddev_pop("ry") * F.stddev_pop("rp")).alias("ic"), F.count(F.lit(1)).alias("n"),
    )


def corrections(df: DataFrame, level: float = 0.05) -> DataFrame:
    """df: (name, p). Bonferroni, Holm and Benjamini-Hochberg decisions."""
    w = Window.partitionBy(F.lit(1)).orderBy("p", "name")  # one row per test
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    d = df.withColumns({"k": F.row_number().over(w), "n": n})
    ok = F.when(F.col("p") <= level / (F.col("n") - F.col("k") + 1), 1).otherwise(0)
    d = d.withColumn("_h", ok).withColumn("holm", F.min("_h").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_b", F.max(F.when(F.col("p") <= level * F.col("k") / F.col("n"), F.col("k"))).over(Window.partitionBy(F.lit(1))))
    return d.select("name", "p", F.when(F.col("p") <= level / F.col("n"), 1).otherwise(0).alias("bonferroni"), "holm", F.when(F.col("k") <= F.col("_b"), 1).otherwise(0).alias("benjamini_hochberg"))


def leakage(df: DataFrame, feature_lags: int = 5) -> DataFrame:
    """df: (feature, symbol, ts, value, r). Rank correlation with returns 1 to 5 bars ahead; a spike means a look ahead."""
    w = Window.partitionBy("feature", "symbol").orderBy("ts")
    d = df.withColumns({f"r{k}": F.lead("r", k).over(w) for k in range(1, feature_lags + 1)}).dropna()
    for x, name in (("value", "rv"), *((f"r{k}", f"k{k}") for k in range(1, feature_lags + 1))):
        d = R.spread_rank(d, x, ["feature"], name)
    g = d.groupBy("feature").agg(*[F.abs(F.try_divide(F.covar_pop("rv", f"k{k}"), F.stddev_pop("rv") * F.stddev_pop(f"k{k}"))).alias(f"c{k}") for k in range(1, feature_lags + 1)])
    cs = [F.col(f"c{k}") for k in range(1, feature_lags + 1)]
    most, mean = F.greatest(*cs), sum(cs[1:], cs[0]) / len(cs)
    g = g.withColumn("look_ahead", 5 * (most - mean))
    top = F.greatest("c1", "look_ahead")
    return g.withColumn("severity", F.when(top > 0.8, "critical").when(top > 0.5, "warning").otherwise("ok"))


def brinson(df: DataFrame) -> DataFrame:
    """df: (sector, wp, rp, wb, rb). Allocation, selection and interaction against the benchmark's total."""
    every = Window.partitionBy(F.lit(1))  # one row per sector
    rb = F.sum(F.col("wb") * F.col("rb")).over(every)
    return df.select(
        "sector", ((F.col("wp") - F.col("wb")) * (F.col("rb") - rb)).alias("allocation"), (F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"),
        ((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction"),
    )


def concentration(df: DataFrame, by: str = "ts") -> DataFrame:
    """df: (by, weight). Herfindahl index, effective number, largest share, long and short sums."""
    a = F.abs("weight")
    g = df.groupBy(by).agg(F.sum(a).alias("gross"), F.sum("weight").alias("net"), F.sum(a * a).alias("_s"), F.max(a).alias("_m"), F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).alias("long"), F.sum(F.when(F.col("weight") < 0, F.col("weight")).otherwise(0.0)).alias("short"), F.sum(F.when(F.col("weight") != 0, 1).otherwise(0)).alias("n_positions"))
    h = F.try_divide(F.col("_s"), F.col("gross") * F.col("gross"))
    return g.withColumns({"hhi": h, "effective": F.try_divide(F.lit(1.0), h), "largest": F.try_divide(F.col("_m"), F.col("gross"))}).drop("_s", "_m")
