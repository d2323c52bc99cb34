"""Queries of drift, model health and portfolio risk (survey 2.4.31 to 2.4.35, 2.4.54, 2.4.73 to 2.4.78, 2.4.123 to 2.4.125) and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.operators import health as H
from tapewright.operators import selection as X
from tapewright.plans import selection as P
from tapewright.plans.aggregates import FT, KS, PSI, _features, _halves
from tapewright.plans.build import rounded
from tapewright.plans.oracle import TICKS, over_bars
from tapewright.sources.tables import bars, ticks

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, make, sql):
    QUERIES[name] = make
    ORACLES[name] = sql


def probability(z: str) -> str:
    tail = " + ".join(f"{2 * (-1) ** (j - 1)} * exp({-2.0 * j * j} * z * z)" for j in range(1, 11))
    return f"(SELECT CASE WHEN z < 0.2 THEN 1 ELSE greatest(least({tail}, 1), 0) END FROM (SELECT {z} AS z))"


DRIFT = [
    *PSI, *KS[len(FT) :], "dp AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi, sqrt(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2) AS js FROM pq GROUP BY feature)",
    "dk AS (SELECT feature, sum(a) AS n, sum(b) AS m, max(d) AS ks FROM k1 GROUP BY feature)",
    f"df AS (SELECT feature, psi, js, ks, n, m, CASE WHEN least(n, m) < 10 THEN 1 ELSE {probability('ks * sqrt(n * m / (n + m))')} END AS p FROM dp JOIN dk USING (feature))",
    "dd AS (SELECT *, CAST(psi > 0.1 OR p < 0.05 OR js > 0.1 AS BIGINT) AS drifted FROM df)",
]
BAD = "CASE WHEN worst >= 0.25 THEN 'critical' WHEN worst >= 0.1 THEN 'high' WHEN n_drifted > n_features * 0.3 THEN 'medium' ELSE 'low' END"
SEVERITY = f"SELECT *, CASE severity WHEN 'critical' THEN 'retrain' WHEN 'low' THEN 'monitor' ELSE 'investigate' END AS advice FROM (SELECT *, {BAD} AS severity FROM (SELECT avg(psi) AS score, max(psi) AS worst, CAST(sum(drifted) AS BIGINT) AS n_drifted, count(*) AS n_features FROM dd))"
add("q_2_4_78_feature_drift", lambda s, d: rounded(H.feature_drift(*_halves(s, d)), "psi", "js", "ks", "p", keys=("feature", "drifted"), digits=5), over_bars("SELECT feature, drifted, round(psi, 5) AS psi, round(js, 5) AS js, round(ks, 5) AS ks, round(p, 5) AS p FROM dd", *DRIFT))
add("q_2_4_73_drift_report", lambda s, d: rounded(H.severity(H.feature_drift(*_halves(s, d))), "score", "worst", keys=("n_drifted", "n_features", "severity", "advice"), digits=5), over_bars(f"SELECT n_drifted, n_features, severity, advice, round(score, 5) AS score, round(worst, 5) AS worst FROM ({SEVERITY})", *DRIFT))


# Predictions: those of the linear model on the bars' features.
def _predictions(s, d) -> DataFrame:
    rows = P.feature_rows(s, d)
    return X.linear_predictor(X.linear_model(rows, P.FEATURES, "y"), P.FEATURES)(rows).withColumn("prediction", F.round("prediction", 9))


PREDICTIONS = P.features_of(*P.shares("f1", "im"), f"bt AS (SELECT {P.BETA} AS beta FROM im_a)", f"pr AS (SELECT f1.*, round({P.PREDICTED(lambda c: c)}, 9) AS prediction FROM f1, bt)")


def _prediction_halves(s, d):
    p = _predictions(s, d).select(F.lit("prediction").alias("feature"), F.col("prediction").alias("value"), "late")
    return [p.where(f"late = {h}").select("feature", "value") for h in (0, 1)]


PREDICTED = [*PREDICTIONS, "ft AS (SELECT 'prediction' AS feature, prediction AS value, late + 1 AS half FROM pr)", *DRIFT[len(FT) :]]
add("q_2_4_74_prediction_drift", lambda s, d: rounded(H.severity(H.feature_drift(*_prediction_halves(s, d))), "score", keys=("n_drifted", "severity", "advice"), digits=4), over_bars(f"SELECT n_drifted, severity, advice, round(score, 4) AS score FROM ({SEVERITY})", *PREDICTED))


def _performance(s, d):
    p = _predictions(s, d).select("symbol", F.col("prediction").alias("score"), F.col("y").alias("r"), "late")
    return H.performance_drift(*[H.performance(p.where(f"late = {h}"), ["symbol"]) for h in (0, 1)])


PF = [
    *PREDICTIONS, f"pf AS (SELECT symbol, late, avg(sign(prediction) * y) / nullif(stddev_samp(sign(prediction) * y), 0) * {math.sqrt(252)!r} AS sharpe, avg(CAST(sign(prediction) = sign(y) AS INTEGER)) AS accuracy, corr(prediction, y) AS ic FROM pr GROUP BY 1, 2)",
    "pd AS (SELECT symbol, " + ", ".join(f"round((a.{c} - b.{c}) / abs(nullif(a.{c}, 0)), 9) AS {c}_drop" for c in ("sharpe", "accuracy", "ic")) + " FROM (SELECT * FROM pf WHERE late = 0) a JOIN (SELECT * FROM pf WHERE late = 1) b USING (symbol))",
    "pe AS (SELECT *, list_filter([sharpe_drop, accuracy_drop, ic_drop], lambda v: v IS NOT NULL) AS v, CAST(coalesce(sharpe_drop > 0.2, false) AS BIGINT) + CAST(coalesce(accuracy_drop > 0.05, false) AS BIGINT) + CAST(coalesce(ic_drop > 0.05, false) AS BIGINT) AS n_over FROM pd)",
]
add(
    "q_2_4_75_performance_drift", lambda s, d: rounded(_performance(s, d), "sharpe_drop", "accuracy_drop", "ic_drop", "score", keys=("symbol", "n_over", "severity"), digits=4),
    over_bars(
        "SELECT symbol, n_over, round(sharpe_drop, 4) AS sharpe_drop, round(accuracy_drop, 4) AS accuracy_drop, round(ic_drop, 4) AS ic_drop, round(coalesce(list_avg(v), 0), 4) AS score,"
        " CASE WHEN coalesce(list_max(v), 0) >= 0.4 THEN 'critical' WHEN coalesce(list_max(v), 0) >= 0.2 THEN 'high' WHEN n_over > 0 THEN 'medium' ELSE 'low' END AS severity FROM pe",
        *PF,
    ),
)

# Windows: trades' prices and sizes by symbol, a baseline against the latest.
def _trades(s, d):
    t = ticks(s, d).select("symbol", "ts", F.col("seq").alias("tie"), F.col("price").alias("price"), F.col("size").cast("double").alias("size"))
    return t.unpivot(["symbol", "ts", "tie"], ["price", "size"], "kind", "value").withColumn("feature", F.concat_ws(":", "symbol", "kind")).select("feature", "ts", "tie", "value")


BASE, LAST = 100, 60
WD = [
    "tr AS (SELECT symbol || ':price' AS feature, ts, seq, price AS value FROM ticks UNION ALL SELECT symbol || ':size', ts, seq, CAST(size AS DOUBLE) FROM ticks)",
    "tk AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY ts, seq) AS k, count(*) OVER (PARTITION BY feature) AS n FROM tr)",
    f"ts0 AS (SELECT feature, value, CASE WHEN k <= {BASE} THEN 1 ELSE 2 END AS half FROM tk WHERE k <= {BASE} OR k > n - {LAST})",
    "k0 AS (SELECT feature, value, count(*) FILTER (half = 1) AS a, count(*) FILTER (half = 2) AS b FROM ts0 GROUP BY 1, 2)", KS[-1],
    "wk AS (SELECT feature, sum(a) AS n, sum(b) AS m, max(d) AS ks FROM k1 GROUP BY 1)", f"wp AS (SELECT feature, CASE WHEN n >= {BASE} AND m >= {LAST // 2} THEN ks ELSE 0 END AS ks, CASE WHEN n >= {BASE} AND m >= {LAST // 2} THEN {probability('ks * sqrt(n * m / (n + m))')} ELSE 1 END AS p FROM wk)",
    "ws AS (SELECT feature, avg(value) FILTER (half = 1) AS rm, avg(value) FILTER (half = 2) AS cm, stddev_pop(value) FILTER (half = 1) AS rs, stddev_pop(value) FILTER (half = 2) AS cs FROM ts0 GROUP BY 1)",
]
add(
    "q_2_4_77_window_drift", lambda s, d: rounded(H.window_drift(_trades(s, d), BASE, LAST), "ref_mean", "ref_sd", "cur_mean", "cur_sd", "ks", "p", keys=("feature", "drifted"), digits=5),
    f"WITH {TICKS}, " + ", ".join(WD) + " SELECT feature, CAST(p < 0.05 AS BIGINT) AS drifted, round(rm, 5) AS ref_mean, round(rs, 5) AS ref_sd, round(cm, 5) AS cur_mean, round(cs, 5) AS cur_sd, round(ks, 5) AS ks, round(p, 5) AS p FROM ws JOIN wp USING (feature)",
)
add("q_2_4_123_reference_bins", lambda s, d: rounded(H.reference_bins(_halves(s, d)[0]), "edge", keys=("feature", "bin")), over_bars("SELECT feature, CAST(i AS INTEGER) AS bin, round(e[i + 1], 6) AS edge FROM ed0, (SELECT unnest(range(11)) AS i)", *FT, f"ed0 AS (SELECT feature, [{', '.join(f'quantile_cont(value, {i / 10})' for i in range(11))}] AS e FROM ft WHERE half = 1 GROUP BY feature)"))


def _history(s, d):
    """A check for each symbol: its second half against its first."""
    f = _features(s, d)
    keyed = f.withColumn("feature", F.concat_ws("|", "symbol", "feature"))
    h = H.feature_drift(*[keyed.where(f"half = {k}").select("feature", "value") for k in (1, 2)])
    return h.withColumns({"check": F.split_part("feature", F.lit("|"), F.lit(1)), "feature": F.split_part("feature", F.lit("|"), F.lit(2))}).withColumn("psi", F.round("psi", 9))


HISTORY = [*FT[:2], FT[2].replace("ft AS", "fz AS"), "ft AS (SELECT symbol || '|' || feature AS feature, half, value FROM fz)", *DRIFT[len(FT) :], "hi AS (SELECT split_part(feature, '|', 1) AS c, split_part(feature, '|', 2) AS feature, round(psi, 9) AS psi, drifted FROM dd)"]
HS = [*HISTORY, f"hc AS (SELECT *, {BAD} AS severity FROM (SELECT c, avg(psi) AS score, max(psi) AS worst, sum(drifted) AS n_drifted, count(*) AS n_features FROM hi GROUP BY c))", "ht AS (SELECT string_agg(feature, ',' ORDER BY k DESC, feature) AS most_drifted FROM (SELECT feature, sum(drifted) AS k FROM hi GROUP BY 1 HAVING k > 0 ORDER BY k DESC, feature LIMIT 5))"]
add(
    "q_2_4_124_drift_summary", lambda s, d: rounded(H.drift_summary(_history(s, d)), "mean_score", keys=("checks", "detected", "critical", "high", "most_drifted"), digits=5),
    over_bars("SELECT count(*) AS checks, count(*) FILTER (n_drifted > 0) AS detected, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, round(avg(score), 5) AS mean_score, any_value(coalesce(most_drifted, '')) AS most_drifted FROM hc, ht", *HS),
)


def _health(s, d):
    alerts = bars(s, d).withColumn("r", R.step_return("close")).where("r is not null").select("ts", F.col("symbol").alias("tie"), F.when(F.abs("r") > 5, "critical").otherwise("info").alias("level"))
    return H.model_health(H.feature_drift(*_prediction_halves(s, d)), H.feature_drift(*_halves(s, d)), alerts)


HE = [*PREDICTED[: len(PREDICTIONS)], *[x for x in PREDICTED[len(PREDICTIONS) :]], "pp AS (SELECT coalesce(max(drifted), 0) AS prediction_drift FROM dd)"]
_RENAMED = {name: f"z_{name}" for name in ("f0", "f1", "ft", "ed", "bn", "sh", "pq", "k0", "k1", "dp", "dk", "df", "dd")}


def _renamed(steps):
    """The same steps under other names, beside those of the predictions."""
    import re

    return [re.sub(r"\b(" + "|".join(_RENAMED) + r")\b", lambda m: _RENAMED[m[1]], x) for x in steps]


HE += [*_renamed(DRIFT), "pq_f AS (SELECT CAST(coalesce(sum(drifted), 0) AS BIGINT) AS n_drifting FROM z_dd)", "al AS (SELECT count(*) FILTER (abs(r) > 5) AS n_critical FROM (SELECT * FROM (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars) WHERE r IS NOT NULL ORDER BY ts DESC, symbol DESC LIMIT 50))", "hh AS (SELECT prediction_drift, n_drifting, n_critical, greatest(0, 100 - 20 * prediction_drift - least(30, 5 * n_drifting) - least(30, 10 * n_critical)) AS health FROM pp, pq_f, al)"]
add("q_2_4_125_model_health", lambda s, d: rounded(_health(s, d), "health", keys=("prediction_drift", "n_drifting", "n_critical", "urgent")), over_bars("SELECT prediction_drift, n_drifting, n_critical, round(health, 6) AS health, CAST(health < 50 AS BIGINT) AS urgent FROM hh", *HE))

# Portfolio risk: symbols held by their share of volume.
RR = "rr AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM days)"
DAYS = "days AS (SELECT symbol, CAST(ts AS DATE) AS ts, last(close ORDER BY bars.ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)"
WE = "we AS (SELECT symbol, sum(volume) / (SELECT sum(volume) FROM days) AS weight FROM days GROUP BY 1)"


def _book(s, d):
    b = bars(s, d)
    days = b.groupBy("symbol", F.to_date("ts").alias("ts")).agg(F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")).withColumn("r", R.pct("close"))
    total = days.agg(F.sum("volume").alias("_t"))
    return days, days.groupBy("symbol").agg(F.sum("volume").alias("v")).crossJoin(F.broadcast(total)).select("symbol", (F.col("v") / F.col("_t")).alias("weight"))  # one row


def _betas(s, d):
    days, weights = _book(s, d)
    market = days.where("r is not null").groupBy("ts").agg(F.avg("r").alias("m"))
    beta = days.join(market, "ts").groupBy("symbol").agg((F.covar_samp("r", "m") / F.var_samp("m")).alias("beta"), F.stddev_samp("r").alias("deviation"))
    return weights.join(beta, "symbol")


BT = [DAYS, RR, WE, "mk AS (SELECT ts, avg(r) AS m FROM rr WHERE r IS NOT NULL GROUP BY 1)", "be AS (SELECT symbol, weight, covar_samp(r, m) / var_samp(m) AS beta, stddev_samp(r) AS deviation FROM rr JOIN mk USING (ts) JOIN we USING (symbol) WHERE r IS NOT NULL GROUP BY 1, 2)"]
CV = [DAYS, RR, WE, "pw AS (SELECT ts, sum(weight * r) AS p FROM rr JOIN we USING (symbol) WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM we))", "cw AS (SELECT symbol, weight, covar_samp(r, p) AS c, stddev_samp(p) AS s FROM rr JOIN pw USING (ts) JOIN we USING (symbol) WHERE r IS NOT NULL GROUP BY 1, 2)"]
add("q_2_4_31_component_var", lambda s, d: rounded(H.component_risk(*_book(s, d)), "weight", "component", "share", "var", keys=("symbol",), digits=5), over_bars("SELECT symbol, round(weight, 5) AS weight, round(1.6448536269514722 * weight * c / s, 5) AS component, round(weight * c / (s * s), 5) AS share, round(1.6448536269514722 * s, 5) AS var FROM cw", *CV))
SHOCKS = {"crash": -0.35, "correction": -0.1, "rally": 0.15}
add(
    "q_2_4_32_beta_stress", lambda s, d: rounded(H.beta_stress(_betas(s, d), s.createDataFrame(list(SHOCKS.items()), "scenario string, shock double")), "shock", "loss", keys=("scenario",), digits=3),
    over_bars("SELECT scenario, round(shock, 3) AS shock, round(1e6 * abs(e * shock), 3) AS loss FROM (SELECT sum(weight * beta) AS e FROM be), (VALUES " + ", ".join(f"('{k}', {v})" for k, v in SHOCKS.items()) + ") t(scenario, shock)", *BT),
)
add(
    "q_2_4_35_breaking_points", lambda s, d: rounded(H.breaking_points(_betas(s, d), ["beta", "deviation"]), "slope", "breaking_point", keys=("factor",), digits=5),
    over_bars(
        "SELECT factor, round(slope, 5) AS slope, CASE WHEN slope >= 0.2 THEN round((floor(0.2 / slope * 1048576) + CASE WHEN 0.2 / slope * 1048576 = floor(0.2 / slope * 1048576) THEN -0.5 ELSE 0.5 END) / 1048576, 5) END AS breaking_point FROM (SELECT 'beta' AS factor, abs(sum(weight * beta)) AS slope FROM be UNION ALL SELECT 'deviation', abs(sum(weight * deviation)) FROM be)",
        *BT,
    ),
)


def _scored(s, d):
    return P.feature_rows(s, d).select("symbol", "ts", F.round("y", 12).alias("r"), F.col("momentum").alias("score"))


DC = P.features_of(
    "d0 AS (SELECT symbol, round(y, 12) AS r, momentum AS score, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS b, ntile(2) OVER (PARTITION BY symbol ORDER BY ts) AS h FROM f1)",
    "d1 AS (SELECT symbol, " + ", ".join(f"avg(r) FILTER (b <= {k}) / nullif(stddev_samp(r) FILTER (b <= {k}), 0) * {math.sqrt(252)!r} AS s{k}" for k in (30, 90, 365)) + ", corr(score, r) FILTER (h = 1) - corr(score, r) FILTER (h = 2) AS ic FROM d0 GROUP BY 1)",
    "d2 AS (SELECT symbol, r, count(*) FILTER (h = 1) AS a, count(*) FILTER (h = 2) AS b FROM d0 GROUP BY 1, 2)",
    "d3 AS (SELECT symbol, max(abs(x)) AS ks FROM (SELECT symbol, sum(a) OVER (PARTITION BY symbol ORDER BY r) / sum(a) OVER (PARTITION BY symbol) - sum(b) OVER (PARTITION BY symbol ORDER BY r) / sum(b) OVER (PARTITION BY symbol) AS x FROM d2) GROUP BY 1)",
    "d4 AS (SELECT *, CAST(coalesce(s30 < 0.5 * s365, false) AS INTEGER) + CAST(coalesce(ic > 0.02, false) AS INTEGER) + CAST(coalesce(ks > 0.1, false) AS INTEGER) AS k FROM d1 JOIN d3 USING (symbol))",
)
add("q_2_4_54_model_decay", lambda s, d: rounded(H.decay(_scored(s, d)), "sharpe_30", "sharpe_90", "sharpe_365", "ic_decay", "ks", keys=("symbol", "severity"), digits=5), over_bars("SELECT symbol, CASE WHEN k >= 2 THEN 'critical' WHEN k = 1 THEN 'warning' ELSE 'ok' END AS severity, round(s30, 5) AS sharpe_30, round(s90, 5) AS sharpe_90, round(s365, 5) AS sharpe_365, round(ic, 5) AS ic_decay, round(ks, 5) AS ks FROM d4", *DC))
