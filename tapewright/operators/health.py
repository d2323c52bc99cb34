"""Drift of features, predictions and performance, windows against a baseline, and a model's health score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.functions.staging import checkpointed
from tapewright.operators import metrics as M

#: From which stability index, test level, divergence and relative drop on something counts.
PSI_WARNING, PSI_CRITICAL, LEVEL, JS_WARNING = 0.10, 0.25, 0.05, 0.10
DROP_WARNING, DROP_CRITICAL, SCORE_WARNING = 0.20, 0.40, 0.05


def kolmogorov(ks: Column, n: Column, m: Column) -> Column:
    """Probability of a distance of two samples as large as this, if they are alike: the limiting distribution."""
    z = ks * F.sqrt(n * m / (n + m))
    tail = F.lit(0.0)
    for j in range(1, 11):
        tail = tail + 2 * (-1) ** (j - 1) * F.exp(-2.0 * j * j * z * z)
    return F.when(z < 0.2, 1.0).otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0)))


def feature_drift(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """Both: (feature, value). By feature: stability index, divergence, KS distance and its probability, and whether any of them is over its limit."""
    d = M.psi(ref, cur).join(M.ks(ref, cur), "feature")
    d = d.withColumn("p", F.when(F.least("n_ref", "n_cur") < 10, 1.0).otherwise(kolmogorov(F.col("ks"), F.col("n_ref"), F.col("n_cur"))))
    return d.withColumn("drifted", ((F.col("psi") > PSI_WARNING) | (F.col("p") < LEVEL) | (F.col("js") > JS_WARNING)).cast("long"))


def severity(drift: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (a group): mean and largest index, drifted features, how bad it is and what to do."""
    g = drift.groupBy(*(by or [])).agg(F.avg("psi").alias("score"), F.max("psi").alias("worst"), F.sum("drifted").alias("n_drifted"), F.count(F.lit(1)).alias("n_features"))
    many = F.col("n_drifted") > F.col("n_features") * 0.3
    bad = F.when(F.col("worst") >= PSI_CRITICAL, "critical").when(F.col("worst") >= PSI_WARNING, "high").when(many, "medium").otherwise("low")
    g = g.withColumn("severity", bad)
    return g.withColumn("advice", F.when(F.col("severity") == "critical", "retrain").when(F.col("severity") == "low", "monitor").otherwise("investigate"))


def performance(df: DataFrame, by: list[str]) -> DataFrame:
    """df: (by, score, r). Sharpe ratio of r times the score's sign, share of equal signs, and correlation of score and r."""
    held = R.sign("score") * F.col("r")
    return df.groupBy(*by).agg(
        (F.try_divide(F.avg(held), F.stddev_samp(held)) * math.sqrt(252)).alias("sharpe"), F.avg((R.sign("score") == R.sign("r")).cast("double")).alias("accuracy"), F.corr("score", "r").alias("ic"),
    )


def performance_drift(ref: DataFrame, cur: DataFrame, key: str = "symbol") -> DataFrame:
    """Both: rows of performance(). Relative drops, their mean, and how bad the largest is."""
    drop = lambda c: F.round(F.when(F.col(c) != 0, (F.col(c) - F.col(f"_{c}")) / F.abs(c)), 9)
    j = ref.join(cur.select(key, *[F.col(c).alias(f"_{c}") for c in ("sharpe", "accuracy", "ic")]), key)
    j = j.select(key, *[drop(c).alias(f"{c}_drop") for c in ("sharpe", "accuracy", "ic")])
    drops = F.filter(F.array("sharpe_drop", "accuracy_drop", "ic_drop"), lambda v: v.isNotNull())
    worst = F.coalesce(F.array_max(drops), F.lit(0.0))
    over = F.coalesce(F.col("sharpe_drop") > DROP_WARNING, F.lit(False)).cast("long") + F.coalesce(F.col("accuracy_drop") > SCORE_WARNING, F.lit(False)).cast("long") + F.coalesce(F.col("ic_drop") > SCORE_WARNING, F.lit(False)).cast("long")
    score = F.coalesce(F.try_divide(F.aggregate(drops, F.lit(0.0), lambda a, b: a + b), F.size(drops)), F.lit(0.0))
    j = j.withColumns({"score": score, "n_over": over, "_worst": worst})
    bad = F.when(F.col("_worst") >= DROP_CRITICAL, "critical").when(F.col("_worst") >= DROP_WARNING, "high").when(F.col("n_over") > 0, "medium").otherwise("low")
    return j.withColumn("severity", bad).drop("_worst")


def windows(df: DataFrame, baseline: int = 1000, recent: int = 100) -> DataFrame:
    """df: (feature, ts, tie, value). The first `baseline` values of each feature as side 'ref', the last `recent` of the others as 'cur'."""
    w = Window.partitionBy("feature")
    x = df.where("value is not null").withColumns({"_k": F.row_number().over(w.orderBy("ts", "tie")), "_n": F.count(F.lit(1)).over(w)})
    side = F.when(F.col("_k") <= baseline, "ref").when(F.col("_k") > F.col("_n") - recent, "cur")
    return x.withColumn("side", side).where("side is not null").select("feature", "value", "side")


def window_drift(df: DataFrame, baseline: int = 1000, recent: int = 100) -> DataFrame:
    """By feature: means and deviations of baseline and recent values, KS distance, probability and `drifted`; too few recent values are never drift."""
    x = checkpointed(windows(df, baseline, recent))  # three branches read it
    ref, cur = x.where("side = 'ref'"), x.where("side = 'cur'")
    stats = x.groupBy("feature").agg(*[f(F.when(F.col("side") == s, F.col("value"))).alias(f"{s}_{n}") for s in ("ref", "cur") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    d = stats.join(M.ks(ref.select("feature", "value"), cur.select("feature", "value")), "feature")
    enough = (F.col("n_ref") >= baseline) & (F.col("n_cur") >= recent // 2)
    p = F.when(enough, kolmogorov(F.col("ks"), F.col("n_ref"), F.col("n_cur"))).otherwise(1.0)
    return d.withColumns({"ks": F.when(enough, F.col("ks")).otherwise(0.0), "p": p}).withColumn("drifted", (F.col("p") < LEVEL).cast("long"))


def reference_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """df: (feature, value). (feature, bin, edge): the quantiles at 0, 1 / bins, ... 1; no feature's values meet in one task."""
    edges = R.percentiles(df, "value", tuple(i / bins for i in range(bins + 1)), ["feature"])
    return edges.select("feature", F.posexplode("q").alias("bin", "edge"))


def drift_summary(history: DataFrame, most: int = 5) -> DataFrame:
    """history: (check, feature, psi, drifted), several checks. (checks, detected, critical, high, mean_score, most_drifted)."""
    checks = severity(history, ["check"])
    counts = history.groupBy("feature").agg(F.sum("drifted").alias("k")).where("k > 0").orderBy(F.desc("k"), "feature").limit(most)
    top = counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "feature"))), lambda s: s["feature"]), ",").alias("most_drifted"))
    whole = checks.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("n_drifted") > 0).alias("detected"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.avg("score").alias("mean_score"),
    )
    return whole.crossJoin(F.broadcast(top))  # a row each


def model_health(predictions: DataFrame, features: DataFrame, alerts: DataFrame, latest: int = 50) -> DataFrame:
    """One row: 100 less 20 for drifted predictions, 5 a drifted feature (30 at most) and 10 a critical one of the latest alerts (30 at most), 0 at least.

    predictions, features: rows with `drifted`; alerts: (ts, tie, level).
    """
    p = predictions.agg(F.coalesce(F.max("drifted"), F.lit(0)).alias("prediction_drift"))
    f = features.agg(F.coalesce(F.sum("drifted"), F.lit(0)).alias("n_drifting"))
    a = alerts.orderBy(F.desc("ts"), F.desc("tie")).limit(latest).agg(F.count_if(F.col("level") == "critical").alias("n_critical"))
    j = p.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(a))  # a row each
    health = F.greatest(F.lit(0), 100 - 20 * F.col("prediction_drift") - F.least(F.lit(30), 5 * F.col("n_drifting")) - F.least(F.lit(30), 10 * F.col("n_critical")))
    return j.withColumn("health", health.cast("double")).withColumn("urgent", (F.col("health") < 50).cast("long"))


def component_risk(returns: DataFrame, weights: DataFrame, z: float = 1.6448536269514722) -> DataFrame:
    """returns: (ts, symbol, r); weights: (symbol, weight). Each symbol's part of the parametric value at risk: weight times covariance with the portfolio.

    The covariance with the portfolio's own return stands for the matrix product, so no pair of symbols
    is formed. Only times that all symbols have count.
    """
    x = returns.where("r is not null").join(F.broadcast(weights), "symbol")  # one row per symbol held
    held = weights.agg(F.count(F.lit(1)).alias("_k"))
    whole = x.groupBy("ts").agg(F.sum(F.col("weight") * F.col("r")).alias("_p"), F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(held)).where("_n = _k")  # one row
    g = x.join(whole.select("ts", "_p"), "ts").groupBy("symbol").agg(F.first("weight").alias("weight"), F.covar_samp("r", "_p").alias("_c"), F.stddev_samp("_p").alias("_s"))
    part = z * F.col("weight") * F.try_divide(F.col("_c"), F.col("_s"))
    g = g.withColumn("component", part)
    return g.select("symbol", "weight", "component", F.try_divide("component", z * F.col("_s")).alias("share"), (z * F.col("_s")).alias("var"))


def beta_stress(positions: DataFrame, scenarios: DataFrame, value: float = 1e6) -> DataFrame:
    """positions: (symbol, weight, beta); scenarios: (scenario, shock), a few. The loss of each scenario if all move with the market."""
    exposure = positions.agg(F.sum(F.col("weight") * F.col("beta")).alias("_e"))
    return scenarios.crossJoin(F.broadcast(exposure)).select("scenario", "shock", (value * F.abs(F.col("_e") * F.col("shock"))).alias("loss"))  # one row


def breaking_points(positions: DataFrame, factors: list[str], limit: float = 0.2, most: float = 1.0, steps: int = 20) -> DataFrame:
    """positions: (weight, a beta column per factor). The shock of each factor at which `limit` of the value is lost, by halving [0, most] `steps` times; null if `most` isn't enough.

    The loss is linear in the shock, so one aggregate gives each factor's slope and the search is arithmetic.
    """
    slopes = positions.agg(*[F.abs(F.sum(F.col("weight") * F.col(f))).alias(f) for f in factors]).unpivot([], factors, "factor", "slope")
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("a"), F.lit(float(most)).alias("b")), lambda s, _: _halved(s, F.col("slope"), limit))
    return slopes.withColumn("breaking_point", F.when(F.col("slope") * most >= limit, (ends["a"] + ends["b"]) / 2))


def _halved(s: Column, slope: Column, limit: float) -> Column:
    middle = (s["a"] + s["b"]) / 2
    lost = slope * middle >= limit
    return F.struct(F.when(lost, s["a"]).otherwise(middle).alias("a"), F.when(lost, middle).otherwise(s["b"]).alias("b"))


def decay(df: DataFrame, spans: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """df: (symbol, ts, r, score). Sharpe ratio of the last rows of each span, fall of the correlation of score and r between halves, KS distance of the halves, and how bad it is."""
    w = Window.partitionBy("symbol")
    x = df.where("r is not null and score is not null").withColumns({"_b": F.row_number().over(w.orderBy(F.desc("ts"))), "_h": F.ntile(2).over(w.orderBy("ts"))})
    sharpe = lambda k: (F.try_divide(F.avg(F.when(F.col("_b") <= k, F.col("r"))), F.stddev_samp(F.when(F.col("_b") <= k, F.col("r")))) * math.sqrt(252)).alias(f"sharpe_{k}")
    half = lambda h: F.corr(F.when(F.col("_h") == h, F.col("score")), F.when(F.col("_h") == h, F.col("r")))
    g = x.groupBy("symbol").agg(*[sharpe(k) for k in spans], (half(1) - half(2)).alias("ic_decay"))
    side = lambda h: x.where(F.col("_h") == h).select(F.col("symbol").alias("feature"), F.col("r").alias("value"))
    g = g.join(M.ks(side(1), side(2)).select(F.col("feature").alias("symbol"), "ks"), "symbol", "left")
    short, long = F.col(f"sharpe_{spans[0]}"), F.col(f"sharpe_{spans[-1]}")
    points = F.coalesce((short < 0.5 * long).cast("int"), F.lit(0)) + F.coalesce((F.col("ic_decay") > 0.02).cast("int"), F.lit(0)) + F.coalesce((F.col("ks") > 0.1).cast("int"), F.lit(0))
    return g.withColumn("severity", F.when(points >= 2, "critical").when(points == 1, "warning").otherwise("ok"))
