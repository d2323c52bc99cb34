"""Queries of order books, audit chains, pre-trade rules, simulations, macro series and models (survey 2.11 to 2.14)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.operators import book as B
from tapewright.operators import models as ML
from tapewright.operators import simulation as S
from tapewright.operators import volatility
from tapewright.plans.aggregates import Q0, _returns, _scored
from tapewright.plans.build import rounded
from tapewright.plans.indicators import RET, step
from tapewright.plans.oracle import TICKS, W, over_bars, roll, rollup
from tapewright.plans.portfolios import ST, U0, _strategies, over_users
from tapewright.sources.tables import bars, rollup as to_bars, seconds, table, ticks

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, make, sql=None):
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


# Books: ticks as level updates, bids under 50 and asks from 50 on, whole prices.
def _updates(s, d):
    t = ticks(s, d)
    p = F.floor("price").cast("double")
    return t.select("symbol", "ts", "seq", F.when(p < 50, "bid").otherwise("ask").alias("side"), p.alias("price"), F.when(F.col("size") % 5 == 0, 0.0).otherwise(F.col("size").cast("double")).alias("size"))


BK = f"""WITH {TICKS}, up AS (SELECT symbol, ts, seq, floor(price)::DOUBLE AS price, CASE WHEN floor(price) < 50 THEN 'bid' ELSE 'ask' END AS side, CASE WHEN size % 5 = 0 THEN 0.0 ELSE size END::DOUBLE AS size FROM ticks),
la AS (SELECT symbol, side, price, last(size ORDER BY ts, seq) AS size FROM up GROUP BY 1, 2, 3), tp AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS k FROM la WHERE size > 0 QUALIFY k <= 10),
bk AS (SELECT symbol, max(CASE WHEN side = 'bid' AND k = 1 THEN price END) AS bp, max(CASE WHEN side = 'ask' AND k = 1 THEN price END) AS ap, max(CASE WHEN side = 'bid' AND k = 1 THEN size END) AS bs, max(CASE WHEN side = 'ask' AND k = 1 THEN size END) AS sa,
 sum(CASE WHEN side = 'bid' THEN size END) AS bd, sum(CASE WHEN side = 'ask' THEN size END) AS ad, sum(CASE WHEN side = 'bid' AND k <= 5 THEN size END) AS b5, sum(CASE WHEN side = 'ask' AND k <= 5 THEN size END) AS a5, sum(CASE WHEN side = 'bid' THEN size / k END) AS lb, sum(CASE WHEN side = 'ask' THEN size / k END) AS la,
 sum(CASE WHEN side = 'bid' THEN price * size / k END) AS pb, sum(CASE WHEN side = 'ask' THEN price * size / k END) AS pa FROM tp GROUP BY symbol HAVING bp IS NOT NULL AND ap IS NOT NULL),
m AS (SELECT *, (bp + ap) / 2 AS mid FROM bk),
pr AS (SELECT symbol AS s0, sum(CASE WHEN side = 'bid' THEN size * exp(-0.5 * (k - 1)) * greatest(0, 1 - abs(price - mid) / mid) END) AS b, sum(CASE WHEN side = 'ask' THEN size * exp(-0.5 * (k - 1)) * greatest(0, 1 - abs(price - mid) / mid) END) AS a FROM tp JOIN m USING (symbol) GROUP BY symbol),
sw AS (SELECT symbol AS s1, sum(q) AS fl, sum(q * price) AS co FROM (SELECT *, greatest(0, least(size, 100.0 - (sum(size) OVER (PARTITION BY symbol ORDER BY k) - size))) AS q FROM tp WHERE side = 'ask') GROUP BY symbol),
al AS (SELECT * FROM m JOIN pr ON s0 = symbol JOIN sw ON s1 = symbol)
"""
MEASURES = {
    "q_2_11_1_book_top": {"mid": "mid", "spread": "ap - bp", "spread_bps": "(ap - bp) / mid * 10000", "crossed": "CASE WHEN bp >= ap THEN 1.0 ELSE 0.0 END"},
    "q_2_11_4_imbalance": {"imbalance_1": "(bs - sa) / (bs + sa)", "imbalance_5": "(b5 - a5) / (b5 + a5)"},
    "q_2_11_7_weighted_imbalance": {"imbalance_weighted": "(lb - la) / (lb + la)"},
    "q_2_11_8_weighted_mid": {"weighted_mid": "(pb / lb + pa / la) / 2"},
    "q_2_11_9_microprice": {"microprice": "(bp * sa + ap * bs) / (bs + sa)"},
    "q_2_11_10_depth": {"bid_depth": "bd", "ask_depth": "ad"},
    "q_2_11_11_pressure": {"pressure": "(b - a) / (b + a)"},
    "q_2_11_20_sweep": {"sweep_filled": "fl", "sweep_price": "co / fl", "impact_bps": "CASE WHEN fl >= 100 THEN (co / fl - mid) / mid * 10000 END"},
}
for _name, _cols in MEASURES.items():
    add(_name, lambda s, d, c=tuple(_cols): rounded(B.measures(B.snapshots(_updates(s, d))), *c, keys=("symbol",)), BK + "SELECT symbol, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _cols.items()) + " FROM al")
add("q_2_11_14_book_levels", lambda s, d: B.snapshots(_updates(s, d)).select("symbol", F.explode(F.array_union(F.transform("bids", lambda x: F.struct(F.lit("bid").alias("side"), x["price"].alias("price"), x["size"].alias("size"))), F.transform("asks", lambda x: F.struct(F.lit("ask").alias("side"), x["price"].alias("price"), x["size"].alias("size"))))).alias("x")).select("symbol", "x.*"), BK + "SELECT symbol, side, price, size FROM tp")

# Audit: events as an audit log, chained by user.
FIELDS = ["event_id", "event_type", "user_id", "props"]
_log = lambda s, d: B.chained(table(s, d, "events"), FIELDS, "user_id", "event_id")
HASH = "sha256(concat_ws('|', CAST(event_id AS VARCHAR), coalesce(event_type, 'None'), coalesce(CAST(user_id AS VARCHAR), 'None'), coalesce(props, 'None')))"
add("q_2_11_24_event_hash", lambda s, d: _log(s, d).select("event_id", "event_hash", "previous_hash"), f"SELECT event_id, {HASH} AS event_hash, coalesce(lag({HASH}) OVER (PARTITION BY user_id ORDER BY event_id), 'GENESIS') AS previous_hash FROM events")
add(
    "q_2_11_23_verify_chain", lambda s, d: B.verify_chain(_log(s, d).withColumn("event_hash", F.when(F.col("event_id") % 997 == 5, F.lit("0")).otherwise(F.col("event_hash"))), FIELDS, "user_id", "event_id").withColumn("first_bad", F.col("first_bad").cast("double")),
    f"WITH h AS (SELECT *, {HASH} AS own FROM events), t AS (SELECT *, CASE WHEN event_id % 997 = 5 THEN '0' ELSE own END AS kept, coalesce(lag(own) OVER (PARTITION BY user_id ORDER BY event_id), 'GENESIS') AS prev FROM h), u AS (SELECT *, kept <> own OR prev <> coalesce(lag(kept) OVER (PARTITION BY user_id ORDER BY event_id), 'GENESIS') AS bad FROM t) SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS n_bad, CAST(min(CASE WHEN bad THEN event_id END) AS DOUBLE) AS first_bad FROM u GROUP BY user_id",
)
add("q_2_11_26_parse_payload", lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k")), "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events")
add(
    "q_2_1_36_audit_query", lambda s, d: table(s, d, "events").where("event_type in ('error', 'purchase') and ts >= '2024-01-10' and ts < '2024-01-20'").select("event_id", "event_type", "user_id").orderBy("event_id").limit(1000),
    "SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('error', 'purchase') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' ORDER BY event_id LIMIT 1000",
)


# Pre-trade: orders of an account against its limits.
def _orders(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return x.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("ts"), F.col("c_nationkey").alias("account"), F.col("o_custkey").alias("symbol"), F.col("c_mktsegment").alias("sector"), F.col("o_totalprice").alias("value"), (F.col("c_acctbal") * 10).alias("position"), (F.col("c_acctbal") * 100).alias("adv"), F.lit(1e6).alias("portfolio"))


LIMITS = {"daily": 2, "least": 5000.0, "most": 300000.0, "adv_share": 0.8, "position": 0.3}
add(
    "q_2_12_45_pretrade", lambda s, d: rounded(B.pretrade(_orders(s, d), LIMITS).withColumn("n_today", F.col("n_today").cast("bigint")), "weight_after", "turnover_today", keys=("order_id", "rule", "verdict", "n_today"), digits=4),
    """WITH o AS (SELECT o_orderkey AS order_id, o_totalprice AS v, c_acctbal, row_number() OVER (PARTITION BY c_nationkey, CAST(o_orderdate AS DATE) ORDER BY o_orderdate, o_orderkey) AS n, sum(o_totalprice) OVER (PARTITION BY c_nationkey, CAST(o_orderdate AS DATE) ORDER BY o_orderdate, o_orderkey) AS t FROM orders JOIN customer ON o_custkey = c_custkey),
    r AS (SELECT *, CASE WHEN n > 2 THEN 'daily_count' WHEN v < 5000 THEN 'min_size' WHEN v > 0.8 * (c_acctbal * 100) THEN 'liquidity' WHEN v > 300000 THEN 'max_size' WHEN (c_acctbal * 10 + v) / 1e6 > 0.3 THEN 'concentration' ELSE 'none' END AS rule FROM o)
    SELECT order_id, rule, CASE WHEN rule = 'none' THEN 'PASSED' WHEN rule IN ('max_size', 'concentration') THEN 'REDUCED' ELSE 'REJECTED' END AS verdict, n AS n_today, round((c_acctbal * 10 + v) / 1e6, 4) AS weight_after, round(t, 4) AS turnover_today FROM r""",
)
add("q_2_12_44_restricted", lambda s, d: _orders(s, d).join(table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("symbol")), "symbol", "left_anti").select("order_id"), "SELECT o_orderkey AS order_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")


# Simulations of every symbol's daily returns: 10,000 paths, 1,000 flips.
PATHS, FLIPS = 10_000, 1_000


def _series(s, d):
    r = to_bars(ticks(s, d), "1 day").withColumn("r", R.pct("close")).where("r is not null")
    return r.select("symbol", (F.row_number().over(R.W) - 1).alias("i"), F.round("r", 12).alias("r"))


SE = ["WITH " + TICKS, rollup("db", "1 DAY"), f"dr AS (SELECT symbol, ts, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM db)", f"se AS (SELECT symbol, row_number() OVER ({W}) - 1 AS i, round(r, 12) AS r FROM dr WHERE r IS NOT NULL)"]
DRAW = lambda *c: "CAST('0x' || substr(md5(concat_ws(':', 7, " + ", ".join(c) + ")), 1, 8) AS BIGINT)"
BP = [
    *SE, "nn AS (SELECT symbol, count(*) AS n FROM se GROUP BY symbol HAVING count(*) >= 5)", f"st AS (SELECT symbol, p, b, {DRAW('symbol', 'p', 'b')} % (n - 5 + 1) AS s, n FROM (SELECT unnest(range({PATHS})) AS p), nn, LATERAL (SELECT unnest(range((n + 4) // 5)) AS b))",
    "ix AS (SELECT symbol, p, b * 5 + j AS k, s + j AS i FROM st, (SELECT unnest(range(5)) AS j) WHERE b * 5 + j < n)", "pt AS (SELECT symbol, p, k, r FROM ix JOIN se USING (symbol, i))",
    "pe AS (SELECT *, exp(sum(ln(greatest(1 + r, 1e-6))) OVER (PARTITION BY symbol, p ORDER BY k)) AS e FROM pt)", "pd AS (SELECT *, e / greatest(max(e) OVER (PARTITION BY symbol, p ORDER BY k), 1.0) - 1 AS dd FROM pe)",
    "pm AS (SELECT symbol, p AS path, last(e ORDER BY k) - 1 AS tr, avg(r) / nullif(stddev_samp(r), 0) AS sh, min(dd) AS md FROM pd GROUP BY symbol, p)",
]
_paths = lambda s, d: S.path_metrics(S.block_paths(_series(s, d), PATHS, 5))
_said = lambda select, steps: ",\n".join(steps) + "\n" + select
add("q_2_12_12_block_bootstrap", lambda s, d: rounded(_paths(s, d), "total_return", "sharpe", "max_drawdown", keys=("symbol", "path"), digits=5), _said("SELECT symbol, path, round(tr, 5) AS total_return, round(sh, 5) AS sharpe, round(md, 5) AS max_drawdown FROM pm", BP))
add(
    "q_2_12_14_bootstrap_interval", lambda s, d: rounded(S.intervals(_paths(s, d), "sharpe"), "p05", "p50", "p95", "mean", "loss_share", keys=("symbol",), digits=5),
    _said("SELECT symbol, round(quantile_cont(sh, 0.05), 5) AS p05, round(quantile_cont(sh, 0.5), 5) AS p50, round(quantile_cont(sh, 0.95), 5) AS p95, round(avg(sh), 5) AS mean, round(avg(CASE WHEN sh < 0 THEN 1.0 ELSE 0 END), 5) AS loss_share FROM pm GROUP BY symbol", BP),
)
add(
    "q_2_12_15_worst_case", lambda s, d: rounded(S.intervals(_paths(s, d), "max_drawdown"), "p05", "p50", "p95", "mean", keys=("symbol",), digits=5),
    _said("SELECT symbol, round(quantile_cont(md, 0.05), 5) AS p05, round(quantile_cont(md, 0.5), 5) AS p50, round(quantile_cont(md, 0.95), 5) AS p95, round(avg(md), 5) AS mean FROM pm GROUP BY symbol", BP),
)
add(
    "q_2_12_16_drawdown_distribution", lambda s, d: rounded(_paths(s, d).groupBy("symbol", F.floor(F.round(F.col("max_drawdown") * -10, 6)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("max_drawdown").alias("mean")), "mean", keys=("symbol", "bin", "n"), digits=5),
    _said("SELECT symbol, CAST(floor(round(md * -10, 6)) AS BIGINT) AS bin, count(*) AS n, round(avg(md), 5) AS mean FROM pm GROUP BY 1, 2", BP),
)
add(
    "q_2_12_19_sharpe_interval", lambda s, d: rounded(S.intervals(_paths(s, d), "sharpe", (0.025, 0.975)), "p02", "p97", keys=("symbol",), digits=5),
    _said("SELECT symbol, round(quantile_cont(sh, 0.025), 5) AS p02, round(quantile_cont(sh, 0.975), 5) AS p97 FROM pm GROUP BY symbol", BP),
)
add(
    "q_2_12_18_sign_flip_test", lambda s, d: rounded(S.sign_flips(_series(s, d), FLIPS), "p_value", keys=("symbol", "hits", "n")),
    _said(f"SELECT symbol, CAST(sum(CASE WHEN round(m, 12) >= round(seen, 12) THEN 1 ELSE 0 END) + 1 AS BIGINT) AS hits, count(*) AS n, round((sum(CASE WHEN round(m, 12) >= round(seen, 12) THEN 1 ELSE 0 END) + 1) / (count(*) + 1), 6) AS p_value FROM (SELECT symbol, p, avg(CASE WHEN {DRAW('symbol', 'p', 'i')} % 2 = 0 THEN r ELSE -r END) AS m FROM se, (SELECT unnest(range({FLIPS})) AS p) GROUP BY symbol, p) JOIN (SELECT symbol, avg(r) AS seen FROM se GROUP BY symbol) USING (symbol) GROUP BY symbol", SE),
)
_long = lambda s, d: _strategies(s, d).groupBy("strategy", "ts").agg(F.round(F.sum(F.col("signal") * F.coalesce("r", F.lit(0.0))), 9).alias("r")).withColumn("i", F.row_number().over(Window.partitionBy("strategy").orderBy("ts")) - 1)
add(
    "q_2_4_84_backtest_overfitting", lambda s, d: rounded(S.backtest_overfitting(_long(s, d)), "pbo", "mean_correlation", "sd_correlation", keys=("n_combos",)),
    over_users(
        """SELECT count(*) AS n_combos, round(avg(CASE WHEN a <> b THEN 1.0 ELSE 0 END), 6) AS pbo, (SELECT round(avg(rho), 6) FROM rh) AS mean_correlation, (SELECT round(stddev_pop(rho), 6) FROM rh) AS sd_correlation FROM (SELECT c, max(CASE WHEN ins = 1 THEN best END) AS a, max(CASE WHEN ins = 0 THEN best END) AS b FROM (SELECT c, ins, last(strategy ORDER BY sh, strategy) AS best FROM sh GROUP BY c, ins) GROUP BY c)""",
        U0, *ST, "lo AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ts) - 1 AS i FROM (SELECT strategy, ts, round(sum(signal * coalesce(r, 0)), 9) AS r FROM st GROUP BY 1, 2))",
        "bs AS (SELECT strategy, CAST(floor(i * 16 / ((SELECT max(i) FROM lo) + 1)) AS BIGINT) AS b, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM lo GROUP BY 1, 2)",
        "co AS (SELECT m AS c, b, (m >> b) & 1 AS ins FROM (SELECT unnest(range(65536)) AS m) , (SELECT unnest(range(16)) AS b) WHERE bit_count(m) = 8)",
        "sh AS (SELECT c, strategy, ins, round((s / n) / nullif(sqrt((q - s * s / n) / (n - 1)), 0), 10) AS sh FROM (SELECT c, strategy, ins, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM bs JOIN co USING (b) GROUP BY 1, 2, 3))",
        "si AS (SELECT c, strategy, max(sh) FILTER (ins = 1) AS x, max(sh) FILTER (ins = 0) AS y FROM sh GROUP BY 1, 2)",
        "sk AS (SELECT c, rank() OVER (PARTITION BY c ORDER BY x) + (count(*) OVER (PARTITION BY c, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY c ORDER BY y) + (count(*) OVER (PARTITION BY c, y) - 1) / 2 AS ry FROM si WHERE x IS NOT NULL AND y IS NOT NULL)",
        "rh AS (SELECT c, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho FROM sk GROUP BY 1)",
    ),
)


# Macro: monthly order statistics as series.
def _macro(s, d):
    o = table(s, d, "orders")
    m = o.groupBy(F.date_trunc("month", "o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("level"), F.count(F.lit(1)).cast("double").alias("activity")).withColumn("symbol", F.lit("all"))
    yoy = lambda c, k: 100 * R.pct(c, k)
    low, high = R.lowest("level", 24), R.highest("level", 24)
    m = m.withColumns({"level_yoy": yoy("level", 12), "activity_yoy": yoy("activity", 12), "level_3m": 100 * (F.pow(F.col("level") / R.lag("level", 3), F.lit(4)) - 1), "range_position": F.try_divide(F.col("level") - low, high - low)})
    growth = F.when((F.col("level_yoy") > 0) & (F.col("activity_yoy") > 0), "expansion").when((F.col("level_yoy") < 0) & (F.col("activity_yoy") < 0), "contraction").when(F.col("level_yoy").isNotNull(), "mixed")
    return m.withColumns({"growth": growth, "inflation": F.when(F.col("level_yoy") > 3, "high").when(F.col("level_yoy").isNotNull(), "low")})


MA = "WITH m AS (SELECT date_trunc('month', o_orderdate) AS ts, avg(o_totalprice) AS l, CAST(count(*) AS DOUBLE) AS a FROM orders GROUP BY 1), x AS (SELECT *, 100 * (l / lag(l, 12) OVER (ORDER BY ts) - 1) AS ly, 100 * (a / lag(a, 12) OVER (ORDER BY ts) - 1) AS ay, 100 * (pow(l / lag(l, 3) OVER (ORDER BY ts), 4) - 1) AS l3, CASE WHEN count(l) OVER w = 24 THEN (l - min(l) OVER w) / nullif(max(l) OVER w - min(l) OVER w, 0) END AS rp FROM m WINDOW w AS (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))\n"
add("q_2_14_5_growth", lambda s, d: rounded(_macro(s, d), "level_yoy", "activity_yoy", keys=("ts",)), MA + "SELECT CAST(epoch(ts) AS BIGINT) AS ts, round(ly, 6) AS level_yoy, round(ay, 6) AS activity_yoy FROM x")
add("q_2_14_2_inflation", lambda s, d: rounded(_macro(s, d), "level_3m", keys=("ts",)), MA + "SELECT CAST(epoch(ts) AS BIGINT) AS ts, round(l3, 6) AS level_3m FROM x")
add("q_2_14_4_range_position", lambda s, d: rounded(_macro(s, d), "range_position", keys=("ts",)), MA + "SELECT CAST(epoch(ts) AS BIGINT) AS ts, round(rp, 6) AS range_position FROM x")
add("q_2_14_8_macro_regimes", lambda s, d: _macro(s, d).select(seconds(), "growth", "inflation"), MA + "SELECT CAST(epoch(ts) AS BIGINT) AS ts, CASE WHEN ly > 0 AND ay > 0 THEN 'expansion' WHEN ly < 0 AND ay < 0 THEN 'contraction' WHEN ly IS NOT NULL THEN 'mixed' END AS growth, CASE WHEN ly > 3 THEN 'high' WHEN ly IS NOT NULL THEN 'low' END AS inflation FROM x")


# Models: rows only, since fits have no SQL.
def _table(s, d):
    df = volatility.realised(bars(s, d), (10, 20)).withColumns({"r": R.pct("close"), "z": R.zscore("close", 20), "y": R.lead(F.ln("close")) - F.ln("close"), "row": F.concat_ws(":", "symbol", F.unix_timestamp("ts")), "late": F.when(F.ntile(2).over(R.W) == 2, 1).otherwise(0)})
    return df.select("row", "symbol", "ts", "r", "z", "volatility_10", "volatility_20", "volume", "y", "late").dropna()


COLUMNS = ["r", "z", "volatility_10", "volatility_20", "volume"]
add("q_2_13_12_cross_fitted", lambda s, d: ML.cross_fitted(_table(s, d), COLUMNS, "y"))
add("q_2_4_94_importance", lambda s, d: ML.importances(_table(s, d), COLUMNS, "y"))
add("q_2_13_10_adversarial", lambda s, d: ML.adversarial(_table(s, d), COLUMNS, "late"))
add("q_2_13_17_calibration", lambda s, d: ML.calibrated(_scored(s, d), "p", "y").select("doc_id", "p", "y", "platt", "isotonic"))
add("q_2_8_49_kmeans_regime", lambda s, d: ML.clustered_regimes(_table(s, d), "volatility_20").select("symbol", seconds(), "regime"))
