"""Queries of cross-sections and portfolios (survey 2.9 and 2.12) and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.operators import crosssection as X
from tapewright.operators import portfolio as P
from tapewright.plans.build import rounded
from tapewright.plans.indicators import RET, step
from tapewright.plans.oracle import TICKS, USER_TICKS, W, lag, over_bars, roll, rollup
from tapewright.sources.tables import bars, daily_universe, seconds, table

QUERIES: dict = {}
ORACLES: dict = {}
EPOCH = "CAST(epoch(ts) AS BIGINT) AS ts"
DAILY = rollup("ub", "1 DAY", "uticks")


def over_users(select, *steps):
    return "WITH " + ",\n".join([USER_TICKS, DAILY, *steps]) + "\n" + select


def add(name, make, sql):
    QUERIES[name] = make
    ORACLES[name] = sql


def _universe(s, d):
    """Daily bars of the wide universe with return and sector."""
    df = daily_universe(s, d)
    return df.withColumns({"r": R.pct("close"), "sector": F.concat(F.lit("s"), (F.col("symbol") % 5).cast("string"))})


U0 = step("u0", {"r": RET(1), "sector": "'s' || CAST(symbol % 5 AS VARCHAR)"}, "ub")
ARANK = lambda x, by="ts": f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2 END"
PCT = lambda x, by="ts": f"({ARANK(x, by)}) / count({x}) OVER (PARTITION BY {by})"


def cross(name, operator, columns, *steps, source):
    QUERIES[name] = lambda s, d: rounded(operator(_universe(s, d)), *columns)
    cols = ", ".join(f"round({e}, 6) AS {n}" for n, e in columns.items())
    ORACLES[name] = over_users(f"SELECT symbol, {EPOCH}, {cols} FROM {source}", U0, *steps)


cross("q_2_9_1_rank", lambda u: X.scores(u, "close"), {"cs_rank": PCT("close")}, source="u0")
cross("q_2_9_2_zscore", lambda u: X.scores(u, "close"), {"cs_z": "(close - avg(close) OVER (PARTITION BY ts)) / (stddev_samp(close) OVER (PARTITION BY ts) + 1e-10)"}, source="u0")
cross("q_2_9_3_sector_relative", lambda u: X.sector_relative(u, "close"), {"sector_relative": "close - avg(close) OVER (PARTITION BY ts, sector)"}, source="u0")
cross("q_2_9_4_relative_strength", lambda u: X.scores(u, "r"), {"cs_relative": "r - avg(r) OVER (PARTITION BY ts)"}, source="u0")
cross("q_2_9_5_percentile_of_score", lambda u: X.percentile_of_score(u, "close"), {"cs_percentile": f"({ARANK('close')} - 0.5) / count(close) OVER (PARTITION BY ts)"}, source="u0")
cross(
    "q_2_9_6_return_zscores", lambda u: X.scores(u.withColumn("r3", R.pct("close", 3)), "r3"),
    {"cs_z": "(r3 - avg(r3) OVER (PARTITION BY ts)) / (stddev_samp(r3) OVER (PARTITION BY ts) + 1e-10)"}, step("u1", {"r3": RET(3)}, "u0"), source="u1",
)
cross("q_2_9_7_sector_momentum", X.sector_momentum, {"sector_momentum": f"{roll('sum(r)', 5)} - {roll('sum(m)', 5)}"}, step("u1", {"m": "CASE WHEN r IS NOT NULL THEN avg(r) OVER (PARTITION BY ts, sector) END"}, "u0"), source="u1")
MC = [step("u1", {f"p{k}": f"round({RET(k)}, 12)" for k in (1, 3, 5)}, "u0"), step("u2", {"sc": " + ".join(f"({PCT(f'p{k}')} - 0.5)" for k in (1, 3, 5))}, "u1"), step("u3", {"m": "sc / 3"}, "u2")]
cross("q_2_9_8_momentum_composite", X.momentum_composite, {"momentum_score": "m"}, *MC, source="u3")
cross(
    "q_2_9_9_volume_momentum", X.volume_momentum, {"volume_momentum": f"{PCT('v')} - 0.5"},
    step("u1", {"s": f"CASE WHEN close > {lag('close')} THEN volume WHEN close < {lag('close')} THEN -volume WHEN {lag('close')} IS NOT NULL THEN 0 END"}, "u0"),
    step("u2", {"v": f"round({roll('sum(s)', 5)} / nullif({roll('sum(volume)', 5)}, 0), 12)"}, "u1"), source="u2",
)
cross("q_2_9_10_risk_adjusted_momentum", X.risk_adjusted_momentum, {"risk_adjusted_momentum": f"{PCT('q')} - 0.5"}, step("u1", {"q": f"round({roll('avg(r)', 5)} / nullif({roll('stddev_samp(r)', 5)}, 0), 9)"}, "u0"), source="u1")
_score = lambda u: X.momentum_composite(u).withColumn("momentum_score", F.round("momentum_score", 9))
SG = [*MC, step("u4", {"sr": "round(m, 9)"}, "u3"), step("u5", {"sg": "CASE WHEN row_number() OVER (PARTITION BY ts ORDER BY sr ASC NULLS LAST, symbol) <= 10 AND sr < -0.1 THEN -1.0 WHEN row_number() OVER (PARTITION BY ts ORDER BY sr DESC NULLS LAST, symbol) <= 10 AND sr > 0.1 THEN 1.0 ELSE 0.0 END"}, "u4")]
_signals = lambda u: X.top_bottom(_score(u), "momentum_score", 10, 0.1)
cross("q_2_9_11_top_bottom", _signals, {"signal": "sg"}, *SG, source="u5")
EW = step("u6", {"w": "CASE WHEN sg <> 0 THEN sg / count(*) OVER (PARTITION BY ts, sign(sg)) ELSE 0.0 END"}, "u5")
cross("q_2_9_12_equal_weights", lambda u: X.equal_weights(_signals(u)), {"weight": "w"}, *SG, EW, source="u6")
cross("q_2_9_13_clipped_weights", lambda u: X.clipped_weights(_signals(u)), {"weight": "greatest(-0.1, least(0.1, coalesce(sg / nullif(sum(CASE WHEN sg <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ts), 0), 0)))"}, *SG, source="u5")
cross("q_2_9_14_rolling_zscore", lambda u: u.withColumn("z", R.zscore("close", 10)), {"z": f"(close - {roll('avg(close)', 10)}) / nullif({roll('stddev_samp(close)', 10)}, 0)"}, source="u0")
cross("q_2_9_29_discretise", lambda u: _score(u).withColumn("d", X.discretise(F.col("momentum_score"))), {"d": "CASE WHEN sr > 0.3 THEN 1.0 WHEN sr < -0.3 THEN -1.0 ELSE 0.0 END"}, *SG, source="u4")


def _strategies(s, d):
    """Three strategies' signals in long form."""
    u = X.risk_adjusted_momentum(X.volume_momentum(_score(_universe(s, d))))
    pairs = [("composite", "momentum_score"), ("volume", "volume_momentum"), ("risk", "risk_adjusted_momentum")]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.round(F.col(c), 9).alias("signal")) for n, c in pairs])).alias("x")
    return u.select("ts", "symbol", "r", each).select("ts", "symbol", "r", "x.*").where("signal is not null")


ST = [
    *MC, step("u4", {"sr": "round(m, 9)", "s": f"CASE WHEN close > {lag('close')} THEN volume WHEN close < {lag('close')} THEN -volume WHEN {lag('close')} IS NOT NULL THEN 0 END", "q": f"round({roll('avg(r)', 5)} / nullif({roll('stddev_samp(r)', 5)}, 0), 9)"}, "u3"),
    step("u5", {"v": f"round({roll('sum(s)', 5)} / nullif({roll('sum(volume)', 5)}, 0), 12)"}, "u4"), step("u6", {"vr": f"round({PCT('v')} - 0.5, 9)", "qr": f"round({PCT('q')} - 0.5, 9)"}, "u5"),
    "st AS (SELECT ts, symbol, r, 'composite' AS strategy, sr AS signal FROM u6 WHERE sr IS NOT NULL UNION ALL SELECT ts, symbol, r, 'volume', vr FROM u6 WHERE vr IS NOT NULL UNION ALL SELECT ts, symbol, r, 'risk', qr FROM u6 WHERE qr IS NOT NULL)",
    """cb AS (SELECT ts, symbol, sum(signal * CASE strategy WHEN 'composite' THEN 0.5 WHEN 'volume' THEN 0.2 ELSE 0.3 END) AS wm, avg(sign(signal)) AS ms, last(signal ORDER BY abs(signal), strategy) AS sg, count(*) AS n,
      sum(CASE WHEN signal > 0 THEN 1 ELSE 0 END) AS nl, sum(CASE WHEN signal < 0 THEN 1 ELSE 0 END) AS ns FROM st GROUP BY 1, 2)""",
]
WEIGHTS = {"composite": 0.5, "volume": 0.2, "risk": 0.3}
_combined = lambda s, d: X.combine(_strategies(s, d), WEIGHTS)
add("q_2_9_20_weighted_signals", lambda s, d: rounded(_combined(s, d), "weighted", keys=("symbol", "ts", "n")), over_users(f"SELECT symbol, {EPOCH}, n, round(wm, 6) AS weighted FROM cb", U0, *ST))
add("q_2_9_21_voting", lambda s, d: rounded(_combined(s, d), "vote"), over_users(f"SELECT symbol, {EPOCH}, CASE WHEN ms > 0.5 THEN 1.0 WHEN ms < -0.5 THEN -1.0 ELSE 0.0 END AS vote FROM cb", U0, *ST))
add("q_2_9_26_strongest_signal", lambda s, d: rounded(_combined(s, d), "strongest"), over_users(f"SELECT symbol, {EPOCH}, round(sg, 6) AS strongest FROM cb", U0, *ST))
add("q_2_9_36_agreement", lambda s, d: rounded(_combined(s, d), "agreement"), over_users(f"SELECT symbol, {EPOCH}, round(greatest(nl, ns, n - nl - ns) / n, 6) AS agreement FROM cb", U0, *ST))
add(
    "q_2_9_24_signal_statistics", lambda s, d: rounded(X.signal_statistics(_strategies(s, d)), "mean", "sd", "long_share", "short_share", "flat_share", keys=("strategy", "n", "n_invalid")),
    over_users("SELECT strategy, count(*) AS n, CAST(sum(CASE WHEN abs(signal) > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_invalid, round(avg(signal), 6) AS mean, round(stddev_samp(signal), 6) AS sd, round(avg(CASE WHEN signal > 0 THEN 1.0 ELSE 0 END), 6) AS long_share, round(avg(CASE WHEN signal < 0 THEN 1.0 ELSE 0 END), 6) AS short_share, round(avg(CASE WHEN signal = 0 THEN 1.0 ELSE 0 END), 6) AS flat_share FROM st GROUP BY strategy", U0, *ST),
)
add(
    "q_2_9_27_strategy_weights",
    lambda s, d: rounded(X.strategy_weights(_strategies(s, d).groupBy("strategy", "ts").agg(F.round(F.sum(F.col("signal") * F.col("r")), 12).alias("r"))), "sharpe", "weight", keys=("strategy",)),
    over_users(
        "SELECT strategy, round(sh, 6) AS sharpe, round(rw / sum(rw) OVER (), 6) AS weight FROM (SELECT *, greatest(sh, 0.1 / count(*) OVER ()) AS rw FROM (SELECT strategy, coalesce(avg(r) / nullif(stddev_samp(r), 0), 0) AS sh FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ts DESC) AS k FROM (SELECT strategy, ts, round(sum(signal * r), 12) AS r FROM st GROUP BY 1, 2)) WHERE k <= 20 GROUP BY strategy))",
        U0, *ST,
    ),
)
add(
    "q_2_9_31_last_rows", lambda s, d: rounded(bars(s, d).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where("k <= 5"), "close"),
    over_bars(f"SELECT symbol, {EPOCH}, round(close, 6) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 5"),
)

# Backtests and portfolios.
_weighted = lambda s, d: X.equal_weights(_signals(_universe(s, d)))
BT = [*SG, EW, step("b0", {"held": f"coalesce({lag('w')}, 0)"}, "u6"), step("b1", {"trade": f"abs(held - coalesce({lag('held')}, 0))"}, "b0"),
      "b2 AS (SELECT ts, sum(coalesce(held * r, 0)) AS gross, sum(trade) / 2 AS turnover, sum(abs(held)) AS exposure FROM b1 GROUP BY ts)", "b3 AS (SELECT *, gross - turnover * 0.0015 AS net FROM b2)"]
add(
    "q_2_12_6_backtest", lambda s, d: rounded(P.backtest(_weighted(s, d)), "gross", "turnover", "exposure", "net", "equity", keys=("ts",)),
    over_users(f"SELECT {EPOCH}, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(exposure, 6) AS exposure, round(net, 6) AS net, round(exp(sum(ln(greatest(1 + net, 1e-6))) OVER (ORDER BY ts)), 6) AS equity FROM b3", U0, *BT),
)
COSTS = [0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.05]
CG = "cg AS (SELECT c AS cost, exp(sum(ln(greatest(1 + gross - turnover * c, 1e-6)))) - 1 AS tr, avg(gross - turnover * c) / nullif(stddev_samp(gross - turnover * c), 0) AS sh FROM b2, (SELECT unnest([0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.05]) AS c) GROUP BY c)"
_grid = lambda s, d: P.cost_grid(P.backtest(_weighted(s, d)), COSTS)
add("q_2_12_8_cost_sensitivity", lambda s, d: rounded(_grid(s, d), "total_return", "sharpe", keys=("cost",)), over_users("SELECT CAST(cost AS DOUBLE) AS cost, round(tr, 6) AS total_return, round(sh, 6) AS sharpe FROM cg", U0, *BT, CG))
add(
    "q_2_12_11_break_even", lambda s, d: rounded(P.break_even(_grid(s, d)), "break_even", keys=()),
    over_users("SELECT round(min(cost + (c2 - cost) * tr / (tr - t2)), 6) AS break_even FROM (SELECT *, lead(cost) OVER (ORDER BY cost) AS c2, lead(tr) OVER (ORDER BY cost) AS t2 FROM cg) WHERE tr > 0 AND t2 <= 0", U0, *BT, CG),
)


def _fills(s, d):
    """Executions: line items as trades, with value and share of their part's quantity."""
    li = table(s, d, "lineitem")
    whole = F.sum("l_quantity").over(Window.partitionBy("l_partkey"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("value"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_quantity") / whole).alias("share"), "l_quantity", "l_returnflag", "l_discount")


FILLS = "WITH f AS (SELECT *, l_extendedprice AS v, l_extendedprice / l_quantity AS p, l_quantity / sum(l_quantity) OVER (PARTITION BY l_partkey) AS sh FROM lineitem)\n"
KEYS = ("l_orderkey", "l_linenumber")
add(
    "q_2_12_1_percentage_cost", lambda s, d: rounded(_fills(s, d).withColumn("cost", P.percentage_cost(F.col("value"), F.col("share"))), "cost", keys=KEYS, digits=4),
    FILLS + "SELECT l_orderkey, l_linenumber, round(greatest(v * 0.001, 1.0) + v * 0.0005 + v * 0.001 * pow(sh, 0.5), 4) AS cost FROM f",
)
add(
    "q_2_12_2_slippage", lambda s, d: rounded(_fills(s, d).withColumns({m: P.slippage(m, F.col("price"), F.col("l_discount"), F.round("share", 4)) for m in ("fixed", "volatility", "volume")}).withColumn("volume", F.round("volume", 4)), "fixed", "volatility", "volume", keys=KEYS, digits=12),
    FILLS + "SELECT l_orderkey, l_linenumber, round(p * 0.0005, 12) AS fixed, round(p * l_discount * 0.1, 12) AS volatility, round(p * 0.0005 * (1 + round(sh, 4) * 10), 4) AS volume FROM f",
)
add(
    "q_2_12_57_square_root_impact", lambda s, d: rounded(_fills(s, d).withColumn("impact", P.square_root_impact(F.col("l_discount"), F.col("share"))), "impact", keys=KEYS),
    FILLS + "SELECT l_orderkey, l_linenumber, round(l_discount * sqrt(greatest(sh, 0)), 6) AS impact FROM f",
)
add(
    "q_2_12_32_kelly", lambda s, d: rounded(_fills(s, d).withColumn("kelly", P.kelly(F.lit(0.5) + F.col("l_discount"), F.col("l_quantity") / 10)), "kelly", keys=KEYS),
    FILLS + "SELECT l_orderkey, l_linenumber, round(greatest(0, least(0.5, ((0.5 + l_discount) * (l_quantity / 10) - (0.5 - l_discount)) / (l_quantity / 10))), 6) AS kelly FROM f",
)
add(
    "q_2_12_33_confidence_size", lambda s, d: rounded(_fills(s, d).withColumns({m: P.confidence_size(F.lit(0.5) + F.col("l_discount"), m) for m in ("linear", "quadratic", "sigmoid")}), "linear", "quadratic", "sigmoid", keys=KEYS),
    FILLS + "SELECT l_orderkey, l_linenumber, round(greatest(0, 2 * (0.5 + l_discount) - 1), 6) AS linear, round(pow(greatest(0, 2 * (0.5 + l_discount) - 1), 2), 6) AS quadratic, round(1 / (1 + exp(-10 * l_discount)), 6) AS sigmoid FROM f",
)

# Weights of customers' holdings by segment, per month.
HOLD = """WITH h AS (SELECT date_trunc('month', o_orderdate) AS ts, o_custkey AS symbol, min(c_mktsegment) AS sector, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
w0 AS (SELECT ts, symbol, sector, v / sum(v) OVER (PARTITION BY ts) * 3 * CASE WHEN symbol % 3 = 0 THEN -1 ELSE 1 END AS weight FROM h),
w1 AS (SELECT *, greatest(-0.05, least(0.05, weight)) AS x1 FROM w0), w2 AS (SELECT *, x1 * least(1.0, coalesce(0.5 / nullif(sum(abs(x1)) OVER (PARTITION BY ts, sector), 0), 1)) AS x2 FROM w1),
w3 AS (SELECT *, x2 * least(1.0, coalesce(1.5 / nullif(sum(abs(x2)) OVER (PARTITION BY ts), 0), 1)) AS x3 FROM w2)
"""


def _holdings(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    h = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.date_trunc("month", "o_orderdate").alias("ts"), F.col("o_custkey").alias("symbol")).agg(F.min("c_mktsegment").alias("sector"), F.sum("o_totalprice").alias("v"))
    sign = F.when(F.col("symbol") % 3 == 0, -1).otherwise(1)
    return h.withColumn("weight", F.col("v") / F.sum("v").over(Window.partitionBy("ts")) * 3 * sign)


_limited = lambda s, d: P.limit_weights(_holdings(s, d), 0.05, 0.5, 1.5)
add("q_2_12_20_position_limits", lambda s, d: rounded(_limited(s, d), "w1", digits=9), HOLD + f"SELECT symbol, {EPOCH}, round(x1, 9) AS w1 FROM w1")
add("q_2_12_21_sector_limits", lambda s, d: rounded(_limited(s, d), "w2", digits=9), HOLD + f"SELECT symbol, {EPOCH}, round(x2, 9) AS w2 FROM w2")
add("q_2_12_22_leverage_limits", lambda s, d: rounded(_limited(s, d), "w3", digits=9), HOLD + f"SELECT symbol, {EPOCH}, round(x3, 9) AS w3 FROM w3")
add(
    "q_2_12_23_violations", lambda s, d: rounded(P.violations(_holdings(s, d), 0.05, 0.7, 2.9), "value", "bound", keys=("ts", "rule", "subject")),
    HOLD + f"SELECT {EPOCH}, 'position' AS rule, CAST(symbol AS VARCHAR) AS subject, round(abs(weight), 6) AS value, 0.05::DOUBLE AS bound FROM w0 WHERE abs(weight) > 0.05 UNION ALL SELECT {EPOCH}, 'sector', sector, round(sum(abs(weight)), 6), 0.7 FROM w0 GROUP BY ts, sector HAVING sum(abs(weight)) > 0.7 UNION ALL SELECT {EPOCH}, 'leverage', 'all', round(sum(abs(weight)), 6), 2.9 FROM w0 GROUP BY ts HAVING sum(abs(weight)) > 2.9",
)


def _two_months(s, d):
    h = _holdings(s, d)
    months = h.groupBy("ts").agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("ts"))
    h = h.join(months.withColumn("k", k), "ts")
    return h.where("k = 1").select("symbol", "weight"), h.where("k = 2").select("symbol", "weight")


TWO = HOLD + ", m AS (SELECT *, dense_rank() OVER (ORDER BY ts) AS k FROM w0), j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(b.weight, 0) - coalesce(a.weight, 0) AS d FROM (SELECT * FROM m WHERE k = 1) a FULL JOIN (SELECT * FROM m WHERE k = 2) b ON a.symbol = b.symbol), t AS (SELECT * FROM j WHERE abs(d) >= 0.001)\n"
add(
    "q_2_12_53_trade_list", lambda s, d: rounded(P.trades(*_two_months(s, d)), "change", "value", keys=("symbol", "side"), digits=4),
    TWO + "SELECT symbol, CASE WHEN d > 0 THEN 'BUY' ELSE 'SELL' END AS side, round(d, 4) AS change, round(abs(d) * 1e6, 4) AS value FROM t",
)
add(
    "q_2_12_27_turnover_cap", lambda s, d: rounded(P.capped_turnover(P.trades(*_two_months(s, d))), "capped", keys=("symbol",), digits=8),
    TWO + "SELECT symbol, round(d * least(1.0, 0.2 / (sum(abs(d)) OVER () / 2)), 8) AS capped FROM t",
)
add(
    "q_2_12_25_rebalance_flags", lambda s, d: rounded(P.rebalance_flags(_limited(s, d).withColumn("target", F.col("w3")), 0.02), "max_drift", "new_day", "new_month", "drifted", keys=("ts",)),
    HOLD + f"SELECT {EPOCH}, round(md, 6) AS max_drift, CASE WHEN pv IS NULL OR date_trunc('day', ts) <> date_trunc('day', pv) THEN 1.0 ELSE 0.0 END AS new_day, CASE WHEN pv IS NULL OR date_trunc('month', ts) <> date_trunc('month', pv) THEN 1.0 ELSE 0.0 END AS new_month, CASE WHEN md > 0.02 THEN 1.0 ELSE 0.0 END AS drifted FROM (SELECT ts, max(abs(weight - x3)) AS md, lag(ts) OVER (ORDER BY ts) AS pv FROM w3 GROUP BY ts)",
)
_returns = lambda s, d: bars(s, d).withColumn("r", R.pct("close")).where("r is not null").select("symbol", "ts", "r")
RR = step("r0", {"r": RET(1)})
IV = "iv AS (SELECT symbol, vol, (1 / vol) / sum(1 / vol) OVER () AS w FROM (SELECT symbol, stddev_samp(r) AS vol FROM r0 GROUP BY symbol))"
add("q_2_12_29_inverse_volatility", lambda s, d: rounded(P.inverse_volatility(_returns(s, d)), "vol", "weight", keys=("symbol",)), over_bars("SELECT symbol, round(vol, 6) AS vol, round(w, 6) AS weight FROM iv", RR, IV))
CV = "cv AS (SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.r, y.r) AS cov, stddev_samp(x.r) AS sx, stddev_samp(y.r) AS sy, count(*) AS n FROM r0 x JOIN r0 y ON x.ts = y.ts WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2)"
add("q_2_4_37_covariance", lambda s, d: rounded(P.covariances(_returns(s, d)), "cov", "corr", keys=("a", "b", "n"), digits=5), over_bars("SELECT a, b, n, round(cov, 5) AS cov, round(cov / (sx * sy), 5) AS corr FROM cv", RR, CV))
add(
    "q_2_12_31_risk_contributions", lambda s, d: rounded(P.risk_contributions(P.covariances(_returns(s, d)), P.inverse_volatility(_returns(s, d))), "contribution", "share", "volatility", keys=("symbol",), digits=5),
    over_bars("SELECT a AS symbol, round(c, 5) AS contribution, round(c / sum(c) OVER (), 5) AS share, round(sqrt(sum(c) OVER ()), 5) AS volatility FROM (SELECT a, sum(cov * p.w * q.w) AS c FROM cv JOIN iv p ON a = p.symbol JOIN iv q ON b = q.symbol GROUP BY a)", RR, IV, CV),
)
add(
    "q_2_12_39_breaker_levels", lambda s, d: P.breaker_levels(bars(s, d)).select("symbol", F.unix_timestamp(F.col("day").cast("timestamp")).alias("day"), "level", seconds()),
    over_bars(
        "SELECT symbol, CAST(epoch(d) AS BIGINT) AS day, CAST(level AS DOUBLE) AS level, CAST(epoch(min(ts)) AS BIGINT) AS ts FROM x0, (SELECT unnest([0.07, 0.13, 0.20]) AS level) WHERE round(fall, 12) >= level GROUP BY 1, 2, 3",
        "x0 AS (SELECT *, CAST(ts AS DATE) AS d, 1 - close / first_value(close) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS fall FROM bars)",
    ),
)
VK = step("k0", {"q": f"{roll('stddev_pop(r)', 5)} / nullif({roll('stddev_pop(r)', 60)}, 0)"}, "r0")
add(
    "q_2_12_41_volatility_breaker", lambda s, d: P.volatility_breaker(bars(s, d)).select("symbol", seconds(), F.round("vol_ratio", 6).alias("vol_ratio"), "breaker"),
    over_bars(f"SELECT symbol, {EPOCH}, round(q, 6) AS vol_ratio, CASE WHEN q > 3 THEN 'halt' WHEN q > 2 THEN 'reduce' WHEN q IS NOT NULL THEN 'normal' END AS breaker FROM k0", RR, VK),
)
add(
    "q_2_12_40_rapid_loss", lambda s, d: rounded(P.rapid_loss(bars(s, d)), "rapid_loss", "rapid_flag"),
    over_bars(f"SELECT symbol, {EPOCH}, round(l, 6) AS rapid_loss, CASE WHEN l <= -0.05 THEN 1.0 ELSE 0.0 END AS rapid_flag FROM (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) - 1 AS l FROM bars)"),
)
