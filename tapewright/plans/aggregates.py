"""Queries of performance, risk, drift and validation statistics (survey 2.4) and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.operators import metrics as M
from tapewright.operators import trend, volatility
from tapewright.plans import portfolios as _p
from tapewright.plans.build import rounded
from tapewright.plans.indicators import RET, step
from tapewright.plans.oracle import W, lag, over_bars, roll
from tapewright.plans.oracle import rollup as sql_rollup
from tapewright.plans.portfolios import HOLD, _holdings, _weighted
from tapewright.sources.tables import bars, rollup, table, ticks

QUERIES: dict = {}
ORACLES: dict = {}
EPOCH = "CAST(epoch(ts) AS BIGINT) AS ts"


def add(name, make, sql):
    QUERIES[name] = make
    ORACLES[name] = sql


def several(prefix, make, source_sql, columns, keys, digits=6):
    """One query for each (id, columns) of a wide aggregate, so that each operator is checked by itself."""
    for name, cols in columns.items():
        QUERIES[f"{prefix}{name}"] = lambda s, d, cols=cols: rounded(make(s, d), *cols, keys=keys, digits=digits)
        ORACLES[f"{prefix}{name}"] = source_sql.format(columns=", ".join([*keys, *[f"round({e}, {digits}) AS {n}" for n, e in cols.items()]]))


def _returns(s, d):
    """Small returns: per-bar change of the 20-bar mean, so that compounding stays finite."""
    df = bars(s, d).withColumn("m", R.mean("close", 20))
    return df.withColumn("r", R.pct("m")).where("r is not null").select("symbol", "ts", "r")


Q0 = [step("q0", {"m": roll("avg(close)", 20)}), f"q1 AS (SELECT symbol, ts, r FROM (SELECT symbol, ts, m / nullif({lag('m')}, 0) - 1 AS r FROM q0) WHERE r IS NOT NULL)"]
G = "ln(greatest(1 + r, 1e-6))"
PERF = over_bars(
    "SELECT {columns} FROM pf",
    *Q0, f"q2 AS (SELECT *, exp(sum({G}) OVER ({W})) AS e FROM q1)", f"q3 AS (SELECT *, e / greatest(max(e) OVER ({W}), 1.0) - 1 AS dd FROM q2)",
    f"""pf AS (SELECT symbol, count(r) AS n, exp(sum({G})) - 1 AS total_return, avg(r) * 252 AS ar, stddev_samp(r) AS sd, avg(r) - 0.05 / 252 AS ex, stddev_samp(CASE WHEN r < 0 THEN r END) AS sdn, min(dd) AS mdd, avg(dd) AS add_, max(r) AS best, min(r) AS worst,
      abs(quantile_cont(r, 0.05)) AS v95, avg(pow(r, 3)) - 3 * avg(r) * avg(r * r) + 2 * pow(avg(r), 3) AS m3, var_pop(r) AS m2, avg(pow(r, 4)) - 4 * avg(r) * avg(pow(r, 3)) + 6 * avg(r) * avg(r) * avg(r * r) - 3 * pow(avg(r), 4) AS m4,
      sum(CASE WHEN r > 0 THEN r END) / -sum(CASE WHEN r < 0 THEN r END) AS omega, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS ps FROM q3 GROUP BY symbol)""",
)
Y = math.sqrt(252)
several(
    "q_2_4_", lambda s, d: M.performance(_returns(s, d)), PERF,
    {
        "3_returns": {"total_return": "total_return", "annual_return": "ar", "best": "best", "worst": "worst"},
        "4_risk_adjusted": {"sharpe": f"ex / sd * {Y!r}", "sortino": f"ex / sdn * {Y!r}", "calmar": "ar / -mdd"},
        "5_risk": {"max_drawdown": "mdd", "avg_drawdown": "add_", "var_95": "v95", "annual_volatility": f"sd * {Y!r}"},
        "15_dashboard": {"skew": "m3 / pow(m2, 1.5)", "kurt": "m4 / (m2 * m2) - 3", "positive_share": "ps"},
        "16_omega": {"omega": "omega"},
        "111_max_drawdown": {"max_drawdown": "mdd"},
    },
    ("symbol", "n"), 5,
)


def _benchmark(s, d):
    r = _returns(s, d)
    return r.withColumn("m", F.avg("r").over(Window.partitionBy("ts")))


several(
    "q_2_4_", lambda s, d: M.benchmark(_benchmark(s, d)),
    over_bars(
        "SELECT {columns} FROM bm", *Q0, "b0 AS (SELECT *, avg(r) OVER (PARTITION BY ts) AS m FROM q1)",
        f"bm AS (SELECT *, (ar - 0.05 / 252 - b * (am - 0.05 / 252)) * 252 AS al, (ar - 0.05 / 252) * 252 / b AS tr FROM (SELECT symbol, covar_samp(r, m) / var_samp(m) AS b, avg(r) AS ar, avg(m) AS am, avg(r - m) / nullif(stddev_samp(r - m), 0) * {Y!r} AS ir, corr(r, m) AS co FROM b0 GROUP BY symbol))",
    ),
    {"106_beta": {"beta": "b", "alpha": "al", "treynor": "tr"}, "26_information_ratio": {"information_ratio": "ir", "correlation": "co"}},
    ("symbol",),
)
VAR = over_bars(
    "SELECT {columns} FROM (SELECT symbol, min(h) AS h, min(p) AS p, avg(CASE WHEN r <= h THEN r END) AS ch, avg(CASE WHEN r <= p THEN r END) AS cp FROM v1 GROUP BY symbol)",
    *Q0, "v0 AS (SELECT symbol AS s0, quantile_cont(r, 0.05) AS h, avg(r) - 1.6448536269514722 * stddev_samp(r) AS p FROM q1 GROUP BY symbol)", "v1 AS (SELECT * FROM q1 JOIN v0 ON symbol = s0)",
)
several("q_2_4_", lambda s, d: M.value_at_risk(_returns(s, d)), VAR, {"27_var": {"historical_var": "h", "parametric_var": "p"}, "30_cvar": {"cvar": "ch", "parametric_cvar": "cp"}}, ("symbol",))
add(
    "q_2_4_17_monthly", lambda s, d: rounded(M.monthly(_returns(s, d)), "r", keys=("symbol", "ts", "n")),
    over_bars(f"SELECT symbol, CAST(epoch(date_trunc('month', ts)) AS BIGINT) AS ts, count(*) AS n, round(exp(sum({G})) - 1, 6) AS r FROM q1 GROUP BY 1, 2", *Q0),
)
STK = over_bars(
    "SELECT {columns} FROM (SELECT symbol, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS w, sum(CASE WHEN r > 0 THEN r END) / -sum(CASE WHEN r < 0 THEN r END) AS f, avg(CASE WHEN r > 0 THEN r END) / -avg(CASE WHEN r < 0 THEN r END) AS p, avg(r) AS e FROM q1 GROUP BY symbol) JOIN (SELECT symbol, CAST(max(CASE WHEN sg > 0 THEN k ELSE 0 END) AS DOUBLE) AS lw, CAST(max(CASE WHEN sg < 0 THEN k ELSE 0 END) AS DOUBLE) AS ll FROM t2 GROUP BY symbol) USING (symbol)",
    *Q0, f"t0 AS (SELECT *, sign(r) AS sg, CASE WHEN sign(r) IS DISTINCT FROM sign({lag('r')}) THEN 1 ELSE 0 END AS nw FROM q1)", f"t1 AS (SELECT *, sum(nw) OVER ({W}) AS rn FROM t0)", "t2 AS (SELECT symbol, rn, min(sg) AS sg, count(*) AS k FROM t1 GROUP BY 1, 2)",
)
several("q_2_4_", lambda s, d: M.streaks(_returns(s, d)), STK, {"6_trading": {"win_rate": "w", "profit_factor": "f", "payoff": "p", "expectancy": "e", "longest_win": "lw", "longest_loss": "ll"}}, ("symbol",))
SHI = over_bars(
    "SELECT {columns} FROM (SELECT *, 1 - g3 * sr + (g4 + 2) / 4 * sr * sr AS vv FROM (SELECT symbol, n, mu / sd AS sr, m3 / pow(m2, 1.5) AS g3, m4 / (m2 * m2) - 3 AS g4 FROM (SELECT symbol, count(r) AS n, avg(r) AS mu, stddev_samp(r) AS sd, var_pop(r) AS m2, avg(pow(r, 3)) - 3 * avg(r) * avg(r * r) + 2 * pow(avg(r), 3) AS m3, avg(pow(r, 4)) - 4 * avg(r) * avg(pow(r, 3)) + 6 * avg(r) * avg(r) * avg(r * r) - 3 * pow(avg(r), 4) AS m4 FROM q1 GROUP BY symbol)))",
    *Q0,
)
several(
    "q_2_4_", lambda s, d: M.sharpe_inference(_returns(s, d)), SHI,
    {"10_probabilistic_sharpe": {"sr": "sr", "se": "sqrt(vv / (n - 1))", "psr_z": "sr / sqrt(vv / (n - 1))"}, "12_min_track_record": {"min_track_record": "1 + vv * pow(1.6448536269514722 / sr, 2)"}},
    ("symbol", "n"), 4,
)


# Executions: line items against the part's retail price.
def _executions(s, d):
    li, part = table(s, d, "lineitem"), table(s, d, "part").select("p_partkey", "p_retailprice", "p_brand")
    x = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    side = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return x.select(
        "l_orderkey", "l_linenumber", F.col("p_brand").alias("symbol"), F.expr("l_shipdate + make_dt_interval(0, l_linenumber)").alias("ts"), F.col("l_extendedprice").alias("value"), side.alias("side"),
        (F.try_divide(price - F.col("p_retailprice"), F.col("p_retailprice")) * side * 1e4).alias("shortfall"), "l_quantity", "l_discount", "l_tax",
    )


EX = "WITH x AS (SELECT l_orderkey, l_linenumber, p_brand AS symbol, l_shipdate + INTERVAL 1 HOUR * l_linenumber AS ts, l_extendedprice AS value, CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END AS side, (l_extendedprice / l_quantity - p_retailprice) / p_retailprice * CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END * 10000 AS shortfall, l_quantity, l_discount, l_tax FROM lineitem JOIN part ON l_partkey = p_partkey)\n"
add("q_2_4_48_shortfall", lambda s, d: rounded(_executions(s, d), "shortfall", keys=("l_orderkey", "l_linenumber"), digits=4), EX + "SELECT l_orderkey, l_linenumber, round(shortfall, 4) AS shortfall FROM x")
add(
    "q_2_4_51_execution_report", lambda s, d: rounded(M.hourly_profile(_executions(s, d)).withColumns({"hour": F.col("hour").cast("double"), "level": F.col("level").cast("bigint")}), "avg_shortfall", "value", keys=("symbol", "hour", "n", "level"), digits=2),
    EX + "SELECT symbol, CAST(hour AS DOUBLE) AS hour, count(*) AS n, CAST(grouping(symbol, hour) AS BIGINT) AS level, round(avg(shortfall), 2) AS avg_shortfall, round(sum(value), 2) AS value FROM (SELECT *, extract(hour FROM ts) AS hour FROM x) GROUP BY ROLLUP (symbol, hour)",
)
add(
    "q_2_4_60_cost_summary",
    lambda s, d: rounded(_executions(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.sum(F.col("value") * F.col("l_tax")).alias("commission"), F.sum(F.col("value") * F.col("l_discount")).alias("slippage"), (F.sum(F.col("value") * (F.col("l_tax") + F.col("l_discount"))) / F.sum("value") * 100).alias("cost_pct"), F.sum(F.when(F.col("side") > 0, 1).otherwise(0)).alias("buys")), "value", "commission", "slippage", "cost_pct", keys=("symbol", "n", "buys"), digits=2),
    EX + "SELECT symbol, count(*) AS n, CAST(sum(CASE WHEN side > 0 THEN 1 ELSE 0 END) AS BIGINT) AS buys, round(sum(value), 2) AS value, round(sum(value * l_tax), 2) AS commission, round(sum(value * l_discount), 2) AS slippage, round(sum(value * (l_tax + l_discount)) / sum(value) * 100, 2) AS cost_pct FROM x GROUP BY symbol",
)
add(
    "q_2_4_58_round_trip_cost", lambda s, d: rounded(_executions(s, d).withColumn("cost", 2 * (F.greatest(F.col("value") * 0.001, F.lit(5.0)) + F.col("value") * 0.0005)), "cost", keys=("l_orderkey", "l_linenumber"), digits=8),
    EX + "SELECT l_orderkey, l_linenumber, round(2 * (greatest(value * 0.001, 5.0) + value * 0.0005), 8) AS cost FROM x",
)


# Drift: bar features, first half against second half of each symbol.
def _features(s, d):
    df = volatility.realised(trend.sma(bars(s, d), 20), (20,))
    df = df.withColumns({"ratio": F.round(F.col("close") / F.col("sma_20"), 9), "vol": F.round("volatility_20", 9), "half": F.ntile(2).over(R.W)})
    df = df.withColumn("volume", F.col("volume").cast("double")).select("symbol", "ts", "half", "ratio", "vol", "volume")
    return df.unpivot(["symbol", "ts", "half"], ["ratio", "vol", "volume"], "feature", "value").where("value is not null")


FT = [
    step("f0", {"r": RET(1)}), step("f1", {"ratio": f"round(close / {roll('avg(close)', 20)}, 9)", "vol": f"round({roll('stddev_samp(r)', 20)}, 9)", "half": f"ntile(2) OVER ({W})"}, "f0"),
    "ft AS (SELECT symbol, ts, half, r, 'ratio' AS feature, ratio AS value FROM f1 WHERE ratio IS NOT NULL UNION ALL SELECT symbol, ts, half, r, 'vol', vol FROM f1 WHERE vol IS NOT NULL UNION ALL SELECT symbol, ts, half, r, 'volume', CAST(volume AS DOUBLE) FROM f1)",
]
_halves = lambda s, d: [_features(s, d).where(f"half = {h}").select("feature", "value") for h in (1, 2)]
PSI = [
    *FT, f"ed AS (SELECT feature AS f, [{', '.join(f'quantile_cont(value, {i / 10})' for i in range(11))}] AS e FROM ft WHERE half = 1 GROUP BY feature)",
    "bn AS (SELECT feature, half, least(len(list_filter(e, lambda x: x <= value)), 10) AS b, count(*) AS n FROM ft JOIN ed ON feature = f WHERE value >= e[1] AND value <= e[11] GROUP BY ALL)",
    "sh AS (SELECT *, n / sum(n) OVER (PARTITION BY feature, half) AS s FROM bn)",
    "pq AS (SELECT coalesce(a.feature, c.feature) AS feature, coalesce(a.s, 0) + 1e-10 AS p, coalesce(c.s, 0) + 1e-10 AS q FROM (SELECT * FROM sh WHERE half = 1) a FULL JOIN (SELECT * FROM sh WHERE half = 2) c ON a.feature = c.feature AND a.b = c.b)",
]
add("q_2_4_70_psi", lambda s, d: rounded(M.psi(*_halves(s, d)), "psi", keys=("feature",)), over_bars("SELECT feature, round(sum((q - p) * ln(q / p)), 6) AS psi FROM pq GROUP BY feature", *PSI))
add("q_2_4_72_jensen_shannon", lambda s, d: rounded(M.psi(*_halves(s, d)), "js", keys=("feature",)), over_bars("SELECT feature, round(sqrt(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2), 6) AS js FROM pq GROUP BY feature", *PSI))
KS = [*FT, "k0 AS (SELECT feature, value, sum(CASE WHEN half = 1 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN half = 2 THEN 1 ELSE 0 END) AS b FROM ft GROUP BY 1, 2)",
      "k1 AS (SELECT *, abs(sum(a) OVER (PARTITION BY feature ORDER BY value) / sum(a) OVER (PARTITION BY feature) - sum(b) OVER (PARTITION BY feature ORDER BY value) / sum(b) OVER (PARTITION BY feature)) AS d FROM k0)"]
add("q_2_4_71_ks", lambda s, d: rounded(M.ks(*_halves(s, d)), "ks", keys=("feature", "n_ref", "n_cur")), over_bars("SELECT feature, CAST(sum(a) AS BIGINT) AS n_ref, CAST(sum(b) AS BIGINT) AS n_cur, round(max(d), 6) AS ks FROM k1 GROUP BY feature", *KS))
add(
    "q_2_4_9_two_sample", lambda s, d: rounded(M.two_sample(*_halves(s, d)), "t", "u", "ks", "mean_diff", "sharpe_diff", keys=("feature",), digits=5),
    over_bars(
        "SELECT feature, round((ma - mb) / sqrt(va / na + vb / nb), 5) AS t, round(ra - na * (na + 1) / 2, 5) AS u, round(d, 5) AS ks, round(ma - mb, 5) AS mean_diff, round((ma / sqrt(va) - mb / sqrt(vb)) * sqrt(252 * 26), 5) AS sharpe_diff FROM (SELECT feature, count(CASE WHEN half = 1 THEN 1 END) AS na, count(CASE WHEN half = 2 THEN 1 END) AS nb, avg(CASE WHEN half = 1 THEN value END) AS ma, avg(CASE WHEN half = 2 THEN value END) AS mb, var_samp(CASE WHEN half = 1 THEN value END) AS va, var_samp(CASE WHEN half = 2 THEN value END) AS vb, sum(CASE WHEN half = 1 THEN rk END) AS ra, max(d) AS d FROM k0 GROUP BY feature)",
        *FT, "k0 AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk, abs(count(*) FILTER (half = 1) OVER (PARTITION BY feature ORDER BY value) / count(*) FILTER (half = 1) OVER (PARTITION BY feature) - count(*) FILTER (half = 2) OVER (PARTITION BY feature ORDER BY value) / count(*) FILTER (half = 2) OVER (PARTITION BY feature)) AS d FROM ft)",
    ),
)
add(
    "q_2_4_76_reference_statistics", lambda s, d: rounded(M.reference_statistics(_features(s, d)), "mean", "sd", "low", "high", "median", keys=("feature", "n"), digits=5),
    over_bars("SELECT feature, count(*) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS sd, round(min(value), 5) AS low, round(max(value), 5) AS high, round(quantile_cont(value, 0.5), 5) AS median FROM ft GROUP BY feature", *FT),
)
LK = [
    *FT, f"l0 AS (SELECT *, {', '.join(f'lead(r, {k}) OVER (PARTITION BY feature, symbol ORDER BY ts) AS r{k}' for k in range(1, 6))} FROM ft)", "l1 AS (SELECT * FROM l0 WHERE r IS NOT NULL AND r5 IS NOT NULL)",
    "l2 AS (SELECT *, " + ", ".join(f"rank() OVER (PARTITION BY feature ORDER BY {c}) + (count(*) OVER (PARTITION BY feature, {c}) - 1) / 2 AS k_{c}" for c in ("value", "r1", "r2", "r3", "r4", "r5")) + " FROM l1)",
    "l3 AS (SELECT feature, " + ", ".join(f"abs(covar_pop(k_value, k_r{k}) / nullif(stddev_pop(k_value) * stddev_pop(k_r{k}), 0)) AS c{k}" for k in range(1, 6)) + " FROM l2 GROUP BY feature)",
    "l4 AS (SELECT *, 5 * (greatest(c1, c2, c3, c4, c5) - (c1 + c2 + c3 + c4 + c5) / 5) AS la FROM l3)",
]
_leak = lambda s, d: M.leakage(_features(s, d).join(bars(s, d).withColumn("r", R.pct("close")).select("symbol", "ts", "r"), ["symbol", "ts"]).drop("half"))
add("q_2_4_129_look_ahead", lambda s, d: rounded(_leak(s, d), "c1", "look_ahead", keys=("feature", "severity"), digits=5), over_bars("SELECT feature, CASE WHEN greatest(c1, la) > 0.8 THEN 'critical' WHEN greatest(c1, la) > 0.5 THEN 'warning' ELSE 'ok' END AS severity, round(c1, 5) AS c1, round(la, 5) AS look_ahead FROM l4", *LK))
add("q_2_4_87_safe_features", lambda s, d: _leak(s, d).where("severity <> 'critical'").select("feature"), over_bars("SELECT feature FROM l4 WHERE greatest(c1, la) <= 0.8", *LK))


# Calibration and classification: quality labels against the share of shorter texts.
def _scored(s, d):
    docs, labels = table(s, d, "documents").select("doc_id", "n_chars"), table(s, d, "labels")
    j = labels.join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), "n_chars")
    return j.withColumn("p", F.round(F.percent_rank().over(Window.partitionBy(F.col("doc_id") % 7).orderBy("n_chars")), 9))


SC = "WITH sc AS (SELECT doc_id, quality AS y, round(percent_rank() OVER (PARTITION BY doc_id % 7 ORDER BY n_chars), 9) AS p FROM labels JOIN documents USING (doc_id))\n"
add("q_2_4_81_reliability", lambda s, d: rounded(M.calibration(_scored(s, d)), "mean_p", "frequency", keys=("bin", "n")), SC + "SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(y AS DOUBLE)), 6) AS frequency FROM sc GROUP BY 1")
add(
    "q_2_4_80_calibration_error", lambda s, d: rounded(M.calibration_error(_scored(s, d)), "ece", "brier", keys=("n",)),
    SC + "SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(m - f)) / sum(n), 6) AS ece, (SELECT round(avg(pow(p - y, 2)), 6) FROM sc) AS brier FROM (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS m, avg(CAST(y AS DOUBLE)) AS f FROM sc GROUP BY 1)",
)
add(
    "q_2_4_104_classification", lambda s, d: rounded(M.classification(_scored(s, d)), "accuracy", "precision", "recall", "f1", "auc", keys=()),
    SC + "SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((rs - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (fp + tn)), 6) AS auc FROM (SELECT CAST(sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, sum(CASE WHEN p >= 0.5 AND y <> 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN p < 0.5 AND y <> 1 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN y = 1 THEN rk END) AS rs FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM sc))",
)


def _forecast(s, d):
    """Next return forecast by the last one's negative."""
    r = _returns(s, d)
    return r.withColumns({"y": F.round(R.lead("r"), 12), "p": F.round(-F.col("r"), 12)}).where("y is not null")


FC = [*Q0, f"fc AS (SELECT * FROM (SELECT symbol, ts, round(lead(r) OVER ({W}), 12) AS y, round(-r, 12) AS p FROM q1) WHERE y IS NOT NULL)",
      "fr AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2 AS rp FROM fc)"]
several(
    "q_2_4_", lambda s, d: M.regression(_forecast(s, d)),
    over_bars("SELECT {columns} FROM (SELECT symbol, avg(pow(y - p, 2)) AS mse, avg(abs(y - p)) AS mae, 1 - avg(pow(y - p, 2)) / var_pop(y) AS r2, avg(CASE WHEN sign(y) = sign(p) THEN 1.0 ELSE 0 END) AS di, covar_pop(ry, rp) / (stddev_pop(ry) * stddev_pop(rp)) AS ic, count(*) AS n FROM fr GROUP BY symbol)", *FC),
    {"53_information_coefficient": {"ic": "ic", "direction": "di"}, "134_regression_metrics": {"mse": "mse", "mae": "mae", "r2": "r2"}}, ("symbol", "n"),
)


def _tests(s, d):
    """A p-value for each customer nation: the share of its balances below zero."""
    c = table(s, d, "customer")
    return c.groupBy(F.col("c_nationkey").cast("string").alias("name")).agg(F.round(F.avg(F.when(F.col("c_acctbal") < 0, 1.0).otherwise(0.0)) / 4, 9).alias("p"))


add(
    "q_2_4_82_multiple_testing", lambda s, d: M.corrections(_tests(s, d), 0.6).select("name", "p", *[F.col(c).cast("bigint").alias(c) for c in ("bonferroni", "holm", "benjamini_hochberg")]),
    """WITH t AS (SELECT CAST(c_nationkey AS VARCHAR) AS name, round(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0 END) / 4, 9) AS p FROM customer GROUP BY 1),
    u AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS n FROM t)
    SELECT name, p, CAST(CASE WHEN p <= 0.6 / n THEN 1 ELSE 0 END AS BIGINT) AS bonferroni, CAST(min(CASE WHEN p <= 0.6 / (n - k + 1) THEN 1 ELSE 0 END) OVER (ORDER BY k) AS BIGINT) AS holm,
    CAST(CASE WHEN k <= max(CASE WHEN p <= 0.6 * k / n THEN k END) OVER () THEN 1 ELSE 0 END AS BIGINT) AS benjamini_hochberg FROM u""",
)


def _sectors(s, d):
    """Portfolio: first half of the orders by year; benchmark: all. Weights by value, returns by mean discount."""
    o, li, c = table(s, d, "orders"), table(s, d, "lineitem"), table(s, d, "customer")
    x = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    own = F.col("o_orderkey") % 2 == 0
    g = x.groupBy(F.col("c_mktsegment").alias("sector")).agg(F.sum(F.when(own, F.col("l_extendedprice"))).alias("vp"), F.avg(F.when(own, F.col("l_discount"))).alias("rp"), F.sum("l_extendedprice").alias("vb"), F.avg("l_discount").alias("rb"))
    w = Window.partitionBy(F.lit(1))
    return g.select("sector", (F.col("vp") / F.sum("vp").over(w)).alias("wp"), "rp", (F.col("vb") / F.sum("vb").over(w)).alias("wb"), "rb")


add(
    "q_2_4_47_brinson", lambda s, d: rounded(M.brinson(_sectors(s, d)), "allocation", "selection", "interaction", keys=("sector",), digits=9),
    """WITH g AS (SELECT c_mktsegment AS sector, sum(CASE WHEN o_orderkey % 2 = 0 THEN l_extendedprice END) AS vp, avg(CASE WHEN o_orderkey % 2 = 0 THEN l_discount END) AS rp, sum(l_extendedprice) AS vb, avg(l_discount) AS rb FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    w AS (SELECT *, vp / sum(vp) OVER () AS wp, vb / sum(vb) OVER () AS wb FROM g)
    SELECT sector, round((wp - wb) * (rb - (SELECT sum(wb * rb) FROM w)), 9) AS allocation, round(wb * (rp - rb), 9) AS selection, round((wp - wb) * (rp - rb), 9) AS interaction FROM w""",
)
CONC = HOLD + """, g AS (SELECT ts, sum(abs(weight)) AS gross, sum(weight) AS net, sum(weight * weight) AS s, max(abs(weight)) AS m, sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) AS lo, sum(CASE WHEN weight < 0 THEN weight ELSE 0 END) AS sh, CAST(sum(CASE WHEN weight <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positions FROM w0 GROUP BY ts)
SELECT {columns} FROM (SELECT * REPLACE (CAST(epoch(ts) AS BIGINT) AS ts) FROM g)"""
several(
    "q_2_4_", lambda s, d: M.concentration(_holdings(s, d)), CONC,
    {"19_concentration": {"hhi": "s / (gross * gross)", "effective": "gross * gross / s", "largest": "m / gross"}, "18_exposure": {"gross": "gross", "net": "net", "long": "lo", "short": "sh"}},
    ("ts", "n_positions"),
)
add(
    "q_2_4_36_sector_exposure", lambda s, d: rounded(_holdings(s, d).groupBy("ts", "sector").agg(F.sum("weight").alias("exposure")), "exposure", keys=("ts", "sector")),
    HOLD + f"SELECT {EPOCH}, sector, round(sum(weight), 6) AS exposure FROM w0 GROUP BY ts, sector",
)
add(
    "q_2_4_22_symbol_attribution", lambda s, d: rounded(_weighted(s, d).groupBy("symbol").agg(F.sum(F.when(F.col("weight") != 0, 1).otherwise(0)).alias("n_active"), F.avg("weight").alias("avg_weight"), F.max("weight").alias("max_weight"), F.min("weight").alias("min_weight")), "avg_weight", "max_weight", "min_weight", keys=("symbol", "n_active")),
    None,
)
ROLLUPS = {"18_rollup_15m": ("15 minutes", "15 MINUTE"), "19_rollup_1h": ("1 hour", "1 HOUR"), "20_rollup_1d": ("1 day", "1 DAY")}
ORACLES["q_2_4_22_symbol_attribution"] = _p.over_users("SELECT symbol, CAST(sum(CASE WHEN w <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_active, round(avg(w), 6) AS avg_weight, round(max(w), 6) AS max_weight, round(min(w), 6) AS min_weight FROM u6 GROUP BY symbol", _p.U0, *_p.SG, _p.EW)
for _name, (_every, _sql) in ROLLUPS.items():
    add(
        f"q_2_1_{_name}", lambda s, d, e=_every: rounded(rollup(ticks(s, d), e), "open", "high", "low", "close", "vwap", keys=("symbol", "ts", "volume", "trade_count"), digits=10),
        over_bars(f"SELECT symbol, {EPOCH}, volume, trade_count, round(open, 10) AS open, round(high, 10) AS high, round(low, 10) AS low, round(close, 10) AS close, round(vwap, 10) AS vwap FROM z", sql_rollup("z", _sql)),
    )
