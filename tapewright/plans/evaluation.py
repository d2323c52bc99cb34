"""Queries of regime tables, snapshots, inference, signals, splits, macro and streamed state (survey 2.4, 2.8, 2.9, 2.12 to 2.15) and their SQL."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.operators import evaluation as V
from tapewright.plans import sequential
from tapewright.plans.aggregates import Q0, _returns
from tapewright.plans.build import rounded
from tapewright.plans.indicators import step
from tapewright.plans.oracle import TICKS, W, lag, over_bars, roll
from tapewright.plans.portfolios import ST, U0, WEIGHTS, _strategies, _universe, over_users
from tapewright.plans.records import MA, _macro
from tapewright.sources.tables import bars, seconds, ticks
from tapewright.streaming import incremental as I

QUERIES: dict = {}
ORACLES: dict = {}
E = lambda c="ts": f"CAST(epoch({c}) AS BIGINT)"
EPOCH = f"{E()} AS ts"
Y = math.sqrt(252)


def add(name, make, sql):
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


# Regimes of the smoothed returns.
_states = lambda s, d: V.direction(_returns(s, d))
RG = [*Q0, f"rg AS (SELECT *, CASE WHEN avg(r) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 0 THEN 'up' ELSE 'down' END AS state FROM q1)"]
RS = [*RG, "rs AS (SELECT symbol, state, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd, exp(sum(ln(1 + greatest(r, -1 + 1e-6)))) - 1 AS tr, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS wr FROM rg GROUP BY 1, 2)"]
RUNS = [*RG, step("ri", {"nw": f"CASE WHEN state = {lag('state')} THEN 0 ELSE 1 END"}, "rg"), step("rn", {"run": f"sum(nw) OVER ({W})"}, "ri")]
TR = [*RG, step("ra", {"after": f"lead(state) OVER ({W})"}, "rg"), "tp AS (SELECT *, n / sum(n) OVER (PARTITION BY symbol, state) AS p FROM (SELECT symbol, state, after, count(*) AS n FROM ra WHERE after IS NOT NULL GROUP BY 1, 2, 3))"]
add("q_2_4_65_regime_statistics", lambda s, d: rounded(V.regime_statistics(_states(s, d)), "share", "mean", "sd", "sharpe", keys=("symbol", "state", "n")), over_bars(f"SELECT symbol, state, n, round(n / sum(n) OVER (PARTITION BY symbol), 6) AS share, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean / nullif(sd, 0) * {Y!r}, 6) AS sharpe FROM rs", *RS))
add("q_2_4_67_regime_frequency", lambda s, d: rounded(V.regime_statistics(_states(s, d)), "share", keys=("symbol", "state")), over_bars("SELECT symbol, state, round(n / sum(n) OVER (PARTITION BY symbol), 6) AS share FROM rs", *RS))
add("q_2_4_62_regime_returns", lambda s, d: rounded(V.regime_statistics(_states(s, d), 10), "total_return", "win_rate", "sharpe", keys=("symbol", "state"), digits=5), over_bars(f"SELECT symbol, state, round(tr, 5) AS total_return, round(wr, 5) AS win_rate, round(mean / nullif(sd, 0) * {Y!r}, 5) AS sharpe FROM rs WHERE n >= 10", *RS))
add("q_2_4_66_regime_durations", lambda s, d: rounded(V.regime_durations(_states(s, d)), "mean_length", keys=("symbol", "state", "runs")), over_bars("SELECT symbol, state, count(*) AS runs, round(avg(k), 6) AS mean_length FROM (SELECT symbol, state, run, count(*) AS k FROM rn GROUP BY 1, 2, 3) GROUP BY 1, 2", *RUNS))
add("q_2_4_68_transition_matrix", lambda s, d: rounded(V.transitions(_states(s, d)), "p", keys=("symbol", "state", "after", "n")), over_bars("SELECT symbol, state, after, n, round(p, 6) AS p FROM tp", *TR))
add("q_2_4_69_expected_duration", lambda s, d: rounded(V.transitions(_states(s, d)).where("state = after"), "expected", keys=("symbol", "state")), over_bars("SELECT symbol, state, round(CASE WHEN p < 1 THEN 1 / (1 - p) END, 6) AS expected FROM tp WHERE state = after", *TR))
add("q_2_8_84_regime_features", lambda s, d: V.regime_age(_states(s, d)).select("symbol", seconds(), "state", "changed", "age"), over_bars(f"SELECT symbol, {EPOCH}, state, CAST(coalesce(state <> {lag('state')}, false) AS BIGINT) AS changed, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) - 1 AS age FROM rn", *RUNS))

# Snapshots and inference.
add("q_2_4_107_snapshot_var", lambda s, d: rounded(V.snapshot_risk(_returns(s, d)), "var", "var_normal", keys=("symbol",)), over_bars("SELECT symbol, round(-quantile_cont(r, 0.05), 6) AS var, round(1.645 * stddev_pop(r) - avg(r), 6) AS var_normal FROM q1 GROUP BY symbol", *Q0))
add("q_2_4_108_snapshot_cvar", lambda s, d: rounded(V.snapshot_risk(_returns(s, d)), "cvar", keys=("symbol",)), over_bars("SELECT symbol, round(avg(r), 6) AS cvar FROM q1 JOIN (SELECT symbol AS s0, quantile_cont(r, 0.05) AS v FROM q1 GROUP BY 1) ON symbol = s0 WHERE r <= v GROUP BY symbol", *Q0))
_N = NormalDist().inv_cdf
BEST = (1 - V.EULER) * _N(0.9) + V.EULER * _N(1 - 1 / (10 * math.e))
M2, M3, M4 = "(avg(r * r) - avg(r) * avg(r))", "(avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * pow(avg(r), 3))", "(avg(pow(r, 4)) - 4 * avg(r) * avg(pow(r, 3)) + 6 * avg(r) * avg(r) * avg(r * r) - 3 * pow(avg(r), 4))"
SH = [*Q0, step("q2", {"pr": lag("r")}, "q1"), f"sq AS (SELECT symbol, count(r) AS n, avg(r) / stddev_samp(r) AS per, avg(r) / stddev_samp(r) * {Y!r} AS sh, {M3} / pow({M2}, 1.5) AS g3, {M4} / ({M2} * {M2}) - 3 AS g4, corr(r, pr) AS rho FROM q2 GROUP BY symbol)"]
add("q_2_4_83_sharpe_t_test", lambda s, d: rounded(V.sharpe_test(_returns(s, d)), "sharpe", "t", keys=("symbol", "n"), digits=5), over_bars(f"SELECT symbol, n, round(sh, 5) AS sharpe, round(sh / (sqrt((1 + 0.5 * sh * sh - g3 * sh + g4 / 4 * sh * sh) / n) * {Y!r} * sqrt((1 + 2 * rho) / (1 - rho))), 5) AS t FROM sq", *SH))
add("q_2_4_127_deflated_sharpe", lambda s, d: rounded(V.sharpe_test(_returns(s, d)), "deflated_z", keys=("symbol",), digits=4), over_bars(f"SELECT symbol, round((per - {BEST!r}) / sqrt((1 - g3 * per + (g4 + 2) / 4 * per * per) / (n - 1)), 4) AS deflated_z FROM sq", *SH))
PTD = lambda unit: f"coalesce(exp(sum(ln(1 + greatest(r, -1 + 1e-6))) FILTER (ts >= date_trunc('{unit}', e))) - 1, 0)"
add("q_2_4_115_period_to_date", lambda s, d: rounded(V.period_to_date(_returns(s, d)), "mtd", "qtd", "ytd", "wtd", keys=("symbol",), digits=5), over_bars("SELECT symbol, " + ", ".join(f"round({PTD(u)}, 5) AS {n}" for n, u in {"mtd": "month", "qtd": "quarter", "ytd": "year", "wtd": "week"}.items()) + " FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS e FROM q1) GROUP BY symbol", *Q0))
DD = step("dd", {"dp": f"100 * (1 - close / max(close) OVER ({W}))"})
EDGES = (0, 2, 5, 10, 15, 20, 30, 50, 100)
add("q_2_4_112_depth_histogram", lambda s, d: V.depth_histogram(bars(s, d)), over_bars("SELECT symbol, bin, count(*) AS n FROM (SELECT symbol, CASE " + " ".join(f"WHEN dp > {a} AND dp <= {b} THEN '{a}-{b}'" for a, b in zip(EDGES[:-1], EDGES[1:])) + " END AS bin FROM dd) WHERE bin IS NOT NULL GROUP BY 1, 2", DD))
add("q_2_4_119_drawdown_alert", lambda s, d: rounded(V.drawdown_alert(bars(s, d)), "dd", keys=("symbol", "alert")), over_bars("SELECT symbol, CASE WHEN x < -0.2 THEN 'critical' WHEN x < -0.1 THEN 'warning' ELSE 'ok' END AS alert, round(x, 6) AS dd FROM (SELECT symbol, -last(dp ORDER BY ts) / 100 AS x FROM dd GROUP BY symbol)", DD))
FM = [*Q0, f"fm AS (SELECT symbol, fold, avg(r) / stddev_samp(r) * {Y!r} AS sharpe, avg(r) * 252 AS mean FROM (SELECT *, ntile(5) OVER ({W}) AS fold FROM q1) GROUP BY 1, 2)"]
_folds = lambda s, d: V.fold_metrics(_returns(s, d))
add("q_2_4_23_fold_summary", lambda s, d: rounded(V.metric_summary(_folds(s, d), ["sharpe", "mean"]), "avg", "sd", "low", "high", "median", keys=("symbol", "metric"), digits=5), over_bars(" UNION ALL ".join(f"SELECT symbol, '{c}' AS metric, round(avg({c}), 5) AS avg, round(stddev_samp({c}), 5) AS sd, round(min({c}), 5) AS low, round(max({c}), 5) AS high, round(quantile_cont({c}, 0.5), 5) AS median FROM fm GROUP BY symbol" for c in ("sharpe", "mean")), *FM))
add("q_2_4_24_fold_stability", lambda s, d: rounded(V.stability(_folds(s, d)), "ratio", "positive_share", keys=("symbol",), digits=5), over_bars("SELECT symbol, round(avg(sharpe) / nullif(stddev_pop(sharpe), 0), 5) AS ratio, round(avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0 END), 5) AS positive_share FROM fm GROUP BY symbol", *FM))
DG = "SELECT symbol, first(sharpe ORDER BY fold) AS b, last(sharpe ORDER BY fold) AS w FROM fm GROUP BY symbol"
add("q_2_4_79_degradation", lambda s, d: rounded(V.degradation(_folds(s, d)), "base", "now", "drop", keys=("symbol", "alert"), digits=5), over_bars(f"SELECT symbol, CASE WHEN (b - w) / abs(b) >= 0.2 THEN 'critical' WHEN (b - w) / abs(b) > 0.1 THEN 'warning' ELSE 'ok' END AS alert, round(b, 5) AS base, round(w, 5) AS now, round((b - w) / nullif(abs(b), 0), 5) AS drop FROM ({DG})", *FM))
IC = [step("u1", {"y": f"round(lead(r) OVER ({W}), 12)", "x": "round(r, 12)"}, "u0"), "u2 AS (SELECT * FROM u1 WHERE x IS NOT NULL AND y IS NOT NULL)"]
AR = lambda x, by: f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2)"
add(
    "q_2_4_55_information_by_time", lambda s, d: rounded(V.information(_universe(s, d).withColumns({"y": F.round(R.lead("r"), 12), "x": F.round("r", 12)}), "x", "y").withColumn("ic", F.when(~F.isnan("ic"), F.col("ic"))), "ic", "mse", "direction", keys=("ts", "n")),
    over_users(f"SELECT {EPOCH}, count(*) AS n, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END, 6) AS ic, round(avg((x - y) * (x - y)), 6) AS mse, round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0 END), 6) AS direction FROM (SELECT *, {AR('x', 'ts')} AS a, {AR('y', 'ts')} AS b FROM u2) GROUP BY ts", U0, *IC),
)
add("q_2_4_38_rank_correlation", lambda s, d: rounded(V.rank_correlation(bars(s, d), "close", "volume"), "pearson", "spearman", keys=("symbol",)), over_bars(f"SELECT symbol, round(corr(close, volume), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM (SELECT *, {AR('close', 'symbol')} AS a, {AR('volume', 'symbol')} AS b FROM bars) GROUP BY symbol"))
add("q_2_4_39_sector_correlation", lambda s, d: rounded(V.sector_correlations(_universe(s, d)), "corr", keys=("sector", "other", "n")), over_users("SELECT x.sector, y.sector AS other, count(*) AS n, round(corr(x.r, y.r), 6) AS corr FROM sm x JOIN sm y ON x.ts = y.ts AND x.sector < y.sector GROUP BY 1, 2 HAVING count(*) >= 3", U0, "sm AS (SELECT ts, sector, avg(r) AS r FROM u0 WHERE r IS NOT NULL GROUP BY 1, 2)"))
FEATURES = ("open", "high", "low", "close", "volume")
add(
    "q_2_4_92_variance_selection", lambda s, d: rounded(bars(s, d).agg(*[F.var_pop(c).alias(c) for c in FEATURES]).unpivot([], list(FEATURES), "feature", "variance").withColumn("k", F.row_number().over(Window.orderBy(F.desc("variance")))).where("variance >= 1 and k <= 3"), "variance", keys=("feature", "k"), digits=4),
    over_bars("SELECT feature, k, round(v, 4) AS variance FROM (SELECT *, row_number() OVER (ORDER BY v DESC) AS k FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_pop({c}) AS v FROM bars" for c in FEATURES) + ")) WHERE v >= 1 AND k <= 3"),
)
add(
    "q_2_4_88_target_correlation", lambda s, d: rounded(bars(s, d).withColumn("y", R.lead("close") - F.col("close")).agg(*[F.corr(c, "y").alias(c) for c in FEATURES]).unpivot([], list(FEATURES), "feature", "corr").withColumn("leaks", (F.abs("corr") > 0.5).cast("long")), "corr", keys=("feature", "leaks")),
    over_bars(" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(abs(corr({c}, y)) > 0.5 AS BIGINT) AS leaks, round(corr({c}, y), 6) AS corr FROM tg" for c in FEATURES), step("tg", {"y": f"lead(close) OVER ({W}) - close"})),
)

# Series.
add("q_2_8_19_half_life", lambda s, d: rounded(V.half_life(bars(s, d)), "half_life", "slope", keys=("symbol",), digits=5), over_bars("SELECT symbol, round(CASE WHEN b > 0 AND b < 1 THEN -ln(2) / ln(b) ELSE 'inf'::DOUBLE END, 5) AS half_life, round(b, 5) AS slope FROM (SELECT symbol, regr_slope(close, p) AS b FROM hl GROUP BY symbol)", step("hl", {"p": lag("close")})))
RM = "OVER (" + W + " ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
RMC = {"rolling_return": f"{roll('avg(r)', 60)} * 252", "rolling_volatility": f"{roll('stddev_samp(r)', 60)} * {Y!r}", "rolling_sharpe": f"{roll('avg(r)', 60)} / {roll('stddev_samp(r)', 60)} * {Y!r}"}
add("q_2_8_9_rolling_metrics", lambda s, d: rounded(V.rolling_metrics(_returns(s, d)), *RMC, digits=5), over_bars(f"SELECT symbol, {EPOCH}, " + ", ".join(f"round({x}, 5) AS {n}" for n, x in RMC.items()) + " FROM q1", *Q0))
add("q_2_8_8_rolling_var", lambda s, d: rounded(V.rolling_metrics(_returns(s, d)), "rolling_var"), over_bars(f"SELECT symbol, {EPOCH}, round(CASE WHEN count(r) {RM} >= 60 THEN -quantile_cont(r, 0.05) {RM} END, 6) AS rolling_var FROM q1", *Q0))
_pair = lambda s, d: bars(s, d).where("symbol in ('click', 'view')").groupBy("ts").agg(F.max(F.when(F.col("symbol") == "click", F.col("close"))).alias("a"), F.max(F.when(F.col("symbol") == "view", F.col("close"))).alias("b")).where("a is not null and b is not null").select(F.lit("click/view").alias("symbol"), "ts", (F.col("a") / F.col("b")).alias("ratio"))
add("q_2_8_90_pair_ratio", lambda s, d: rounded(_pair(s, d).withColumn("z", R.zscore("ratio", 20)), "ratio", "z"), over_bars(f"SELECT symbol, {EPOCH}, round(ratio, 6) AS ratio, round((ratio - {roll('avg(ratio)', 20)}) / nullif({roll('stddev_samp(ratio)', 20)}, 0), 6) AS z FROM pr", "pr AS (SELECT 'click/view' AS symbol, x.ts, x.close / y.close AS ratio FROM bars x JOIN bars y ON x.ts = y.ts AND x.symbol = 'click' AND y.symbol = 'view')"))
add("q_2_8_75_smoothed_signal", lambda s, d: rounded(_returns(s, d).withColumn("smooth", R.mean(F.signum("r"), 3, least=1)), "smooth"), over_bars(f"SELECT symbol, {EPOCH}, round(avg(sg) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smooth FROM (SELECT *, sign(r) AS sg FROM q1)", *Q0))
add("q_2_12_7_execution_shift", lambda s, d: rounded(bars(s, d).withColumn("execution", R.lead("open")).withColumn("slip", R.quotient("execution", "close") - 1), "execution", "slip"), over_bars(f"SELECT symbol, {EPOCH}, round(o, 6) AS execution, round(o / close - 1, 6) AS slip FROM nx", step("nx", {"o": f"lead(open) OVER ({W})"})))

# Signals of several strategies.
add("q_2_9_22_rank_average", lambda s, d: rounded(V.rank_average(_strategies(s, d)), "rank_average"), over_users(f"SELECT symbol, {EPOCH}, round(avg(p), 6) AS rank_average FROM (SELECT symbol, ts, {AR('signal', 'strategy, ts')} / count(*) OVER (PARTITION BY strategy, ts) - 0.5 AS p FROM st) GROUP BY symbol, ts", U0, *ST))
add("q_2_9_23_signal_threshold", lambda s, d: rounded(_strategies(s, d).withColumn("kept", F.when(F.abs("signal") < 0.1, 0.0).otherwise(F.col("signal"))), "kept", keys=("strategy", "symbol", "ts")), over_users(f"SELECT strategy, symbol, {EPOCH}, round(CASE WHEN abs(signal) < 0.1 THEN 0 ELSE signal END, 6) AS kept FROM st", U0, *ST))
add("q_2_9_25_signal_validation", lambda s, d: _strategies(s, d).groupBy("strategy").agg(F.bool_and(F.col("signal").isNotNull() & (F.abs("signal") <= 1)).cast("long").alias("valid"), F.count_if(F.abs("signal") > 1).alias("n_over")), over_users("SELECT strategy, CAST(bool_and(signal IS NOT NULL AND abs(signal) <= 1) AS BIGINT) AS valid, count(*) FILTER (abs(signal) > 1) AS n_over FROM st GROUP BY strategy", U0, *ST))
add("q_2_9_30_contribution", lambda s, d: rounded(V.contribution(_strategies(s, d), WEIGHTS), "weight", "mean", "sd", "long_pct", "short_pct", "neutral_pct", keys=("strategy",)), over_users("SELECT strategy, CASE strategy WHEN 'composite' THEN 0.5 WHEN 'volume' THEN 0.2 ELSE 0.3 END::DOUBLE AS weight, round(avg(signal), 6) AS mean, round(stddev_samp(signal), 6) AS sd, " + ", ".join(f"round(100 * avg(CASE WHEN signal {o} 0 THEN 1.0 ELSE 0 END), 6) AS {n}_pct" for n, o in {"long": ">", "short": "<", "neutral": "="}.items()) + " FROM st GROUP BY strategy", U0, *ST))
add("q_2_9_35_ensemble_weights", lambda s, d: rounded(_strategies(s, d).withColumn("weight", F.try_divide("signal", F.count_if(F.col("signal") != 0).over(Window.partitionBy("strategy", "ts")))), "weight", keys=("strategy", "symbol", "ts"), digits=8), over_users(f"SELECT strategy, symbol, {EPOCH}, round(signal / nullif(count(*) FILTER (signal <> 0) OVER (PARTITION BY strategy, ts), 0), 8) AS weight FROM st", U0, *ST))
_ranked = lambda s, d: _universe(s, d).where("r is not null").withColumn("p", F.round(R.average_rank(F.round("r", 12), "ts") / F.count("r").over(Window.partitionBy("ts")), 9))
add("q_2_9_18_score_to_signal", lambda s, d: rounded(V.scored_signals(_ranked(s, d), "p"), "signal"), over_users(f"SELECT symbol, {EPOCH}, CASE WHEN row_number() OVER (PARTITION BY ts ORDER BY p DESC, symbol) <= 5 AND p > 0.6 THEN 1.0 WHEN row_number() OVER (PARTITION BY ts ORDER BY p, symbol) <= 5 AND p < 0.4 THEN -1.0 ELSE 0.0 END AS signal FROM rk", U0, "rk AS (SELECT *, round(" + AR("x", "ts") + " / count(*) OVER (PARTITION BY ts), 9) AS p FROM (SELECT *, round(r, 12) AS x FROM u0 WHERE r IS NOT NULL))"))

# Splits.
add("q_2_13_1_train_test", lambda s, d: bars(s, d).withColumn("train", V.share_of(bars(s, d))).select("symbol", seconds(), "train"), over_bars(f"SELECT symbol, {EPOCH}, CAST(row_number() OVER ({W}) <= floor(0.7::DOUBLE * count(*) OVER (PARTITION BY symbol)) AS BIGINT) AS train FROM bars"))
CB = [
    step("ix", {"i": f"row_number() OVER ({W}) - 1", "block": f"ntile(5) OVER ({W}) - 1"}), "bd AS (SELECT symbol AS s0, block AS b0, min(i) AS a, max(i) AS b FROM ix GROUP BY 1, 2)",
    "co AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS combo, x, y FROM (SELECT unnest(range(5)) AS x), LATERAL (SELECT unnest(range(5)) AS y) WHERE x < y)",
]
add(
    "q_2_13_4_combinatorial_folds", lambda s, d: V.combinatorial_folds(bars(s, d)),
    over_bars("SELECT symbol, combo, count(*) FILTER (block = x OR block = y) AS n_test, count(*) FILTER (NOT (i BETWEEN p.a - 3 AND p.b + 3 OR i BETWEEN q.a - 3 AND q.b + 3)) AS n_train FROM ix, co JOIN bd p ON p.b0 = x JOIN bd q ON q.b0 = y WHERE p.s0 = symbol AND q.s0 = symbol GROUP BY 1, 2", *CB),
)

# Macro.
add("q_2_14_3_activity_features", lambda s, d: rounded(_macro(s, d).withColumns({"change": R.change("activity"), "change_3m": R.ratio(R.change("activity", 3), F.lit(3.0)), "mean_12m": R.mean("activity", 12)}), "change", "change_3m", "mean_12m", "activity_yoy", keys=("ts",)), MA + f"SELECT {EPOCH}, a - lag(a) OVER (ORDER BY ts) AS change, round((a - lag(a, 3) OVER (ORDER BY ts)) / 3, 6) AS change_3m, round(CASE WHEN count(a) OVER v = 12 THEN avg(a) OVER v END, 6) AS mean_12m, round(ay, 6) AS activity_yoy FROM x WINDOW v AS (ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
add("q_2_14_9_inflation_regime", lambda s, d: _macro(s, d).select(seconds(), "inflation"), MA + f"SELECT {EPOCH}, CASE WHEN ly > 3 THEN 'high' WHEN ly IS NOT NULL THEN 'low' END AS inflation FROM x")
add("q_2_14_10_monetary_regime", lambda s, d: _macro(s, d).withColumn("c", R.change("level") / 1000).select(seconds(), F.when(F.col("c") > 0.1, "tightening").when(F.col("c") < -0.1, "easing").when(F.col("c").isNotNull(), "neutral").alias("monetary")), MA + f"SELECT {EPOCH}, CASE WHEN c > 0.1 THEN 'tightening' WHEN c < -0.1 THEN 'easing' WHEN c IS NOT NULL THEN 'neutral' END AS monetary FROM (SELECT ts, (l - lag(l) OVER (ORDER BY ts)) / 1000 AS c FROM x)")
add("q_2_14_11_risk_regime", lambda s, d: _macro(s, d).withColumn("m", R.roll(lambda c: F.percentile(c, F.lit(0.5)), "level", 12)).select(seconds(), F.when(F.col("level") < F.col("m"), "risk_on").when(F.col("m").isNotNull(), "risk_off").alias("risk")), MA + f"SELECT {EPOCH}, CASE WHEN l < m THEN 'risk_on' WHEN m IS NOT NULL THEN 'risk_off' END AS risk FROM (SELECT *, CASE WHEN count(l) OVER v = 12 THEN quantile_cont(l, 0.5) OVER v END AS m FROM x WINDOW v AS (ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))")


# Streamed state: each feature by itself, and marks of positions.
def _streamed(*columns):
    return lambda s, d: rounded(I.drained(I.feature_stream(I.timed_tick_stream(s, d)), "features"), *columns, keys=("symbol", "seq"))


def position_marks(spark, sf_dir):
    """Quantity (purchases of even sizes less sales of odd ones), last price and value by symbol as the stream has left them, and each value's share."""
    signed = F.when(F.col("size") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    live = I.tick_stream(spark, sf_dir).groupBy("symbol").agg(F.sum(signed).alias("quantity"), F.max_by("price", F.struct("ts", "seq")).alias("price"))
    m = I.drained_table(live, "marks").withColumn("value", F.col("quantity") * F.col("price"))
    total = Window.partitionBy(F.lit(1))  # one row per symbol
    return rounded(m.withColumn("weight", F.try_divide("value", F.sum(F.abs("value")).over(total))), "price", "value", "weight", keys=("symbol", "quantity"))


_src = sequential.ORACLES["q_2_15_10_stream_features"]
_from = _src[_src.index("FROM (SELECT symbol, seq") :]
for _name, _cols in {"q_2_15_3_stream_rolling": {"mean_20": "m", "sd_20": "s", "low_20": "l", "high_20": "h"}, "q_2_15_5_stream_ema": {"ema_12": "f", "ema_26": "g"}, "q_2_15_7_stream_macd": {"macd": "f - g"}, "q_2_15_8_stream_bollinger": {"mean_20": "m", "pct_b": "CASE WHEN s > 0 THEN (price - m + 2 * s) / (4 * s) ELSE 0.5 END"}}.items():
    add(_name, _streamed(*_cols), f"WITH {TICKS} SELECT symbol, seq, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in _cols.items()) + " " + _from.replace("SELECT symbol, seq,", "SELECT symbol, seq, price,"))
_PAST = "OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_RSI = f"list_reduce(list({{'k': 0::BIGINT, 'x': price, 'g': 0.0::DOUBLE, 'l': 0.0::DOUBLE}}) {_PAST}, lambda a, b: {{'k': a.k + 1, 'x': b.x, 'g': a.g + (greatest(b.x - a.x, 0) - a.g) / least(a.k + 1, 14), 'l': a.l + (greatest(a.x - b.x, 0) - a.l) / least(a.k + 1, 14)}})"
add("q_2_15_6_stream_rsi", _streamed("rsi_14"), f"WITH {TICKS} SELECT symbol, seq, round(CASE WHEN v.k = 0 THEN 50 WHEN v.l = 0 THEN 100 ELSE 100 - 100 / (1 + v.g / v.l) END, 6) AS rsi_14 FROM (SELECT symbol, seq, {_RSI} AS v FROM ticks)")
add("q_2_15_18_position_marks", position_marks, f"WITH {TICKS}, m AS (SELECT symbol, CAST(sum(CASE WHEN size % 2 = 0 THEN size ELSE -size END) AS BIGINT) AS quantity, last(price ORDER BY ts, seq) AS price FROM ticks GROUP BY symbol) SELECT symbol, quantity, round(price, 6) AS price, round(quantity * price, 6) AS value, round(quantity * price / nullif(sum(abs(quantity * price)) OVER (), 0), 6) AS weight FROM m")
