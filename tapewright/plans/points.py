"""Queries at a point in time (survey 2.3) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.operators import points as P
from tapewright.plans.build import rounded
from tapewright.plans.indicators import RET, step
from tapewright.plans.oracle import TICKS, USER_TICKS, W, lag, over_bars, roll
from tapewright.plans.preparation import DIM, _dim
from tapewright.sources.tables import bars, seconds, table, ticks, user_ticks

QUERIES: dict = {}
ORACLES: dict = {}
E = lambda c="ts": f"CAST(epoch({c}) AS BIGINT)"
AS_OF, AS_OF_SQL = "2024-01-20 00:00:00", "TIMESTAMP '2024-01-20'"


def add(name, make, sql):
    QUERIES[name] = make
    ORACLES[name] = sql


def day(c):
    return F.unix_timestamp(F.col(c).cast("timestamp")).alias(c)


# Index membership: a user symbol is in the index of its event type from its first to its last tick of it, open-ended for every fourth.
def _spells(s, d):
    g = table(s, d, "events").groupBy(F.col("event_type").alias("index"), F.col("user_id").alias("symbol")).agg(F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("end"))
    return g.withColumn("end", F.when(F.col("symbol") % 4 != 0, F.col("end")))


def _dates(s, d):
    return table(s, d, "events").select(F.to_date("ts").alias("d")).distinct()


SPELLS = "WITH sp AS (SELECT event_type AS idx, user_id AS symbol, CAST(min(ts) AS DATE) AS a, CASE WHEN user_id % 4 <> 0 THEN CAST(max(ts) AS DATE) END AS b FROM events GROUP BY 1, 2), ds AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)\n"
add("q_2_3_3_index_membership", lambda s, d: P.members(_spells(s, d), _dates(s, d)).groupBy("index", day("d")).agg(F.count(F.lit(1)).alias("n"), F.sum("symbol").alias("total")), SPELLS + f"SELECT idx AS \"index\", {E('d')} AS d, count(*) AS n, CAST(sum(symbol) AS BIGINT) AS total FROM sp JOIN ds ON a <= d AND (b IS NULL OR d <= b) GROUP BY 1, 2")
add("q_2_3_5_index_changes", lambda s, d: P.membership_changes(_spells(s, d), "2024-01-10", "2024-01-20").select("index", "symbol", day("d"), "change"), SPELLS + f"SELECT idx AS \"index\", symbol, {E('a')} AS d, 'added' AS change FROM sp WHERE a BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' UNION ALL SELECT idx, symbol, {E('b')}, 'removed' FROM sp WHERE b BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
add(
    "q_2_3_7_universe_load", lambda s, d: rounded(user_ticks(s, d).where(F.col("ts") <= AS_OF).join(_dim(s, d).where("listing <= '2024-01-20' and (delist is null or delist >= '2024-01-20')").select("symbol"), "symbol", "left_semi"), "price", keys=("symbol", "seq")),
    DIM.rstrip() + f", {USER_TICKS} SELECT symbol, seq, round(price, 6) AS price FROM uticks WHERE ts <= {AS_OF_SQL} AND symbol IN (SELECT symbol FROM dim WHERE listing <= DATE '2024-01-20' AND (delist IS NULL OR delist >= DATE '2024-01-20'))",
)


# Actions: every 40th tick of a symbol is one; every third of them was never announced.
def _actions(s, d):
    t = ticks(s, d).where("seq % 40 = 0")
    kind = F.when(F.col("seq") % 80 == 0, "split").otherwise("dividend")
    return t.select("symbol", "seq", F.col("ts").alias("ex_ts"), kind.alias("kind"), F.when(kind == "split", F.lit(2.0)).otherwise(1.0).alias("ratio"), F.when(kind == "dividend", F.lit(0.5)).otherwise(0.0).alias("amount"), F.when(F.col("seq") % 3 != 0, F.col("ts") - F.expr("interval 5 days")).alias("announced"))


ACT = "act AS (SELECT symbol, seq, ts AS ex, CASE WHEN seq % 80 = 0 THEN 'split' ELSE 'dividend' END AS kind, CASE WHEN seq % 80 = 0 THEN 2.0 ELSE 1.0 END AS ratio, CASE WHEN seq % 80 = 0 THEN 0.0 ELSE 0.5 END AS amount, CASE WHEN seq % 3 <> 0 THEN ts - INTERVAL 5 DAY END AS announced FROM ticks WHERE seq % 40 = 0)"
add("q_2_3_33_actions_of_symbol", lambda s, d: _actions(s, d).where("symbol = 'view' and kind = 'split' and ex_ts >= '2024-01-05' and ex_ts <= '2024-01-25'").select("symbol", "seq", "kind", seconds("ex_ts")), f"WITH {TICKS}, {ACT} SELECT symbol, seq, kind, CAST(floor(epoch(ex)) AS BIGINT) AS ex_ts FROM act WHERE symbol = 'view' AND kind = 'split' AND ex BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'")
add("q_2_3_34_known_actions", lambda s, d: P.known_actions(_actions(s, d), AS_OF).select("symbol", "seq", "kind"), f"WITH {TICKS}, {ACT} SELECT symbol, seq, kind FROM act WHERE announced <= {AS_OF_SQL}")
add("q_2_3_18_adjustment_log", lambda s, d: P.adjustment_log(bars(s, d), _actions(s, d)).select("symbol", "seq", "kind", "n_bars"), over_bars("SELECT a.symbol, a.seq, a.kind, count(b.ts) AS n_bars FROM act a LEFT JOIN bars b ON a.symbol = b.symbol AND b.ts < a.ex GROUP BY 1, 2, 3", ACT))
KNOWN = [
    ACT, f"kb AS (SELECT * FROM bars WHERE ts <= {AS_OF_SQL})",
    f"ka AS (SELECT a.*, (SELECT arg_min(close, ts) FROM kb WHERE kb.symbol = a.symbol AND kb.ts >= a.ex) AS con FROM act a WHERE ex <= {AS_OF_SQL})",
    "kf AS (SELECT symbol, ex, CASE WHEN kind = 'split' THEN -ln(ratio) WHEN con > amount THEN ln((con - amount) / con) END AS lp, CASE WHEN kind = 'split' THEN ln(ratio) END AS lv FROM ka)",
    "kj AS (SELECT b.symbol, b.ts, coalesce(sum(f.lp), 0) AS lp, coalesce(sum(f.lv), 0) AS lv, min(b.close) AS close, min(b.volume) AS volume FROM kb b LEFT JOIN kf f ON f.symbol = b.symbol AND b.ts < f.ex GROUP BY 1, 2)",
]
_known = lambda s, d: P.known_adjusted(bars(s, d), _actions(s, d), AS_OF)
LOGS = {"log_close": "ln(close) + lp", "log_volume": "lv"}
add("q_2_3_9_known_adjustment", lambda s, d: rounded(_known(s, d).withColumn("log_close", R.log("close") + F.col("log_price")), *LOGS, digits=5), over_bars(f"SELECT symbol, {E()} AS ts, " + ", ".join(f"round({e}, 5) AS {n}" for n, e in LOGS.items()) + " FROM kj", *KNOWN))


def _as_of(s, d):
    """Universe, bars, adjustment and metadata in one: symbols with over 20 bars by the date, each bar with its symbol's count."""
    k = _known(s, d)
    meta = k.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars")).where("n_bars > 20")
    return k.join(meta, "symbol")


add("q_2_3_10_as_of_query", lambda s, d: rounded(_as_of(s, d).withColumn("log_close", R.log("close") + F.col("log_price")), "log_close", keys=("symbol", "ts", "n_bars"), digits=5), over_bars(f"SELECT symbol, {E()} AS ts, n_bars, round(ln(close) + lp, 5) AS log_close FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_bars FROM kj) WHERE n_bars > 20", *KNOWN))
add("q_2_3_11_as_of_returns", lambda s, d: rounded(_known(s, d).withColumn("log_return", R.log("close") + F.col("log_price") - R.lag(R.log("close") + F.col("log_price"), 5)), "log_return", digits=5), over_bars(f"SELECT symbol, {E()} AS ts, round(x - {lag('x', 5)}, 5) AS log_return FROM (SELECT *, ln(close) + lp AS x FROM kj)", *KNOWN))
NAMES = ("click", "error", "purchase", "signup", "view")
add(
    "q_2_3_31_as_of_panel", lambda s, d: _known(s, d).withColumn("x", F.round(R.log("close") + F.col("log_price"), 5) + F.lit(0.0)).groupBy(seconds()).pivot("symbol", list(NAMES)).agg(F.first("x")),
    over_bars(f"SELECT {E()} AS ts, " + ", ".join(f"max(CASE WHEN symbol = '{n}' THEN round(ln(close) + lp, 5) END) AS {n}" for n in NAMES) + " FROM kj GROUP BY ts", *KNOWN),
)


def _ends(s, d):
    return ticks(s, d).agg(F.date_trunc("day", F.min("ts")).alias("a"), F.date_trunc("day", F.max("ts")).alias("b")).select(F.explode(F.sequence(F.col("a"), F.col("b"), F.expr("interval 36 hours"))).alias("end"))


ENDS = "es AS (SELECT unnest(generate_series(date_trunc('day', a), date_trunc('day', b), INTERVAL 36 HOUR)) AS e FROM (SELECT min(ts) AS a, max(ts) AS b FROM ticks))"
add("q_2_3_12_as_of_series", lambda s, d: rounded(P.as_of_series(bars(s, d), _ends(s, d)).select(F.unix_timestamp("end").alias("end"), "symbol", seconds("bar_ts"), "close"), "close", keys=("end", "symbol", "bar_ts")), over_bars(f"SELECT {E('e')} AS \"end\", symbol, {E('max(ts)')} AS bar_ts, round(arg_max(close, ts), 6) AS close FROM es JOIN bars ON ts <= e GROUP BY e, symbol", ENDS))
add("q_2_3_13_look_ahead", lambda s, d: P.look_ahead(bars(s, d).where((F.col("symbol") != "click") | (F.col("ts") <= AS_OF)), AS_OF).select("symbol", seconds("last_ts"), "n_late", F.col("clean").cast("bigint").alias("clean")), over_bars(f"SELECT symbol, {E('max(ts)')} AS last_ts, CAST(sum(CASE WHEN ts > {AS_OF_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS n_late, CAST(max(ts) <= {AS_OF_SQL} AS BIGINT) AS clean FROM bars WHERE symbol <> 'click' OR ts <= {AS_OF_SQL} GROUP BY symbol"))

# Alignment.
_momentum = lambda s, d: bars(s, d).select("symbol", "ts", R.pct("close", 5).alias("momentum")).dropna()
_reversion = lambda s, d: bars(s, d).select("symbol", "ts", R.zscore("close", 20).alias("reversion")).dropna()
SIGNALS = step("sg", {"m": RET(5), "z": f"(close - {roll('avg(close)', 20)}) / nullif({roll('stddev_samp(close)', 20)}, 0)"})
add("q_2_3_25_signal_intersection", lambda s, d: rounded(P.aligned(_momentum(s, d), _reversion(s, d)), "momentum", "reversion"), over_bars(f"SELECT symbol, {E()} AS ts, round(m, 6) AS momentum, round(z, 6) AS reversion FROM sg WHERE m IS NOT NULL AND z IS NOT NULL", SIGNALS))
_r = lambda s, d: bars(s, d).withColumn("r", R.pct("close")).dropna(subset=["r"])
add(
    "q_2_3_26_benchmark_alignment", lambda s, d: rounded(P.aligned(_r(s, d).where("symbol <> 'view'").select("symbol", "ts", "r"), _r(s, d).where("symbol = 'view'").select("ts", F.col("r").alias("benchmark")), on=("ts",)).withColumn("excess", F.col("r") - F.col("benchmark")), "r", "benchmark", "excess"),
    over_bars(f"SELECT a.symbol, {E('a.ts')} AS ts, round(a.r, 6) AS r, round(b.r, 6) AS benchmark, round(a.r - b.r, 6) AS excess FROM r0 a JOIN r0 b ON a.ts = b.ts WHERE a.symbol <> 'view' AND b.symbol = 'view' AND a.r IS NOT NULL AND b.r IS NOT NULL", step("r0", {"r": RET(1)})),
)
add(
    "q_2_3_27_feature_target", lambda s, d: rounded(P.feature_target(bars(s, d).withColumn("momentum", R.pct("close", 5)), ["momentum"], 3), "momentum", "target"),
    over_bars(f"SELECT symbol, {E()} AS ts, round(m, 6) AS momentum, round(t, 6) AS target FROM ft WHERE m IS NOT NULL AND t IS NOT NULL", step("ft", {"m": RET(5), "t": f"lead(close, 3) OVER ({W}) / nullif(close, 0) - 1"})),
)
add(
    "q_2_3_28_execution_market", lambda s, d: rounded(P.execution_market(ticks(s, d).select("symbol", "seq", "size"), bars(s, d)).withColumn("share", F.try_divide("size", "adv")), "sigma", "share", "last_close", keys=("symbol", "seq", "n_bars")),
    over_bars("SELECT t.symbol, seq, n_bars, round(sigma, 6) AS sigma, round(size / nullif(adv, 0), 6) AS share, round(last_close, 6) AS last_close FROM ticks t LEFT JOIN (SELECT symbol, stddev_samp(r) AS sigma, avg(volume) AS adv, arg_max(close, ts) AS last_close, count(*) AS n_bars FROM r0 GROUP BY symbol) x ON x.symbol = t.symbol", step("r0", {"r": RET(1)})),
)


def _pairs(s, d):
    r = _r(s, d).select("symbol", "ts", "r")
    both = r.select(F.col("symbol").alias("a"), "ts", F.col("r").alias("x")).join(r.select(F.col("symbol").alias("b"), "ts", F.col("r").alias("y")), "ts").where("a < b")
    return both.groupBy("a", "b").agg(F.corr("x", "y").alias("corr"), F.count(F.lit(1)).alias("n")).where("abs(corr) >= 0.005").orderBy(F.desc(F.abs("corr")))


add("q_2_3_30_symbol_pairs", lambda s, d: rounded(_pairs(s, d), "corr", keys=("a", "b", "n")), over_bars("SELECT a, b, n, round(c, 6) AS corr FROM (SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, corr(x.r, y.r) AS c FROM r0 x JOIN r0 y ON x.ts = y.ts AND x.symbol < y.symbol WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2) WHERE abs(c) >= 0.005", step("r0", {"r": RET(1)})))
