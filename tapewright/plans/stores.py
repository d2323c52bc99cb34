"""Queries of feature views, stacking and corrected streams (survey 2.3.20, 2.13.16, 2.15.2, 2.15.14, 2.15.17) and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.operators import stacking as K
from tapewright.operators import views as V
from tapewright.plans import selection as X
from tapewright.plans.build import rounded
from tapewright.plans.oracle import TICKS, exchange_steps, over_bars, pivots, products, rollup
from tapewright.sources.tables import bars, ticks
from tapewright.streaming import late as L
from tapewright.streaming import orders as O
from tapewright.streaming.incremental import drained, shared_dir

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, make, sql=None):
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


# 2.3.20: closes of bars, known at their end, every fifth corrected two hours later; hourly prices, known ten minutes after their end.
def historical(s, d):
    b = bars(s, d).select("symbol", (F.col("ts") + F.expr("interval 15 minutes")).alias("ts"), "close", F.row_number().over(R.W).alias("k"))
    corrected = b.where("k % 5 = 0").withColumns({"close": F.col("close") * 1.01, "known": F.col("ts") + F.expr("interval 2 hours")})
    closes = b.withColumn("known", F.col("ts")).unionByName(corrected)
    hours = bars(s, d, "1 hour").withColumn("ts", F.col("ts") + F.expr("interval 1 hour")).withColumn("known", F.col("ts") + F.expr("interval 10 minutes"))
    views = [V.FeatureView("bar", closes, ["close"], 3600, "known"), V.FeatureView("hour", hours, ["high", "volume"], 86400, "known")]
    out = V.historical_features(ticks(s, d).select("symbol", "ts", "seq"), views)
    return rounded(out, "bar__close", "hour__high", "hour__volume", keys=("seq", "bar__age", "hour__age"))


AGE = "CAST(floor(epoch(e.ts)) - floor(epoch(v.t)) AS BIGINT)"
HF = [
    "va AS (SELECT symbol, ts + INTERVAL 15 MINUTE AS t, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars)",
    "vb AS (SELECT symbol, t, t AS c, close AS x FROM va UNION ALL SELECT symbol, t, t + INTERVAL 2 HOUR, close * 1.01 FROM va WHERE k % 5 = 0)",
    rollup("hours", "1 HOUR"), "vc AS (SELECT symbol, ts + INTERVAL 1 HOUR AS t, ts + INTERVAL 70 MINUTE AS c, high, volume FROM hours)",
    "fa AS (SELECT e.seq, max({'t': v.t, 'c': v.c, 'x': v.x}) AS v FROM ticks e JOIN vb v ON v.symbol = e.symbol AND v.t <= e.ts AND v.c <= e.ts GROUP BY 1)",
    "fb AS (SELECT e.seq, max({'t': v.t, 'c': v.c, 'high': v.high, 'volume': v.volume}) AS v FROM ticks e JOIN vc v ON v.symbol = e.symbol AND v.t <= e.ts AND v.c <= e.ts GROUP BY 1)",
    f"ga AS (SELECT e.seq, v.x AS x, {AGE} AS age FROM ticks e JOIN fa USING (seq) WHERE {AGE} <= 3600)", f"gb AS (SELECT e.seq, v.high AS high, v.volume AS volume, {AGE} AS age FROM ticks e JOIN fb USING (seq) WHERE {AGE} <= 86400)",
]
add("q_2_3_20_historical_features", historical, over_bars("SELECT e.seq, round(ga.x, 6) AS bar__close, ga.age AS bar__age, round(gb.high, 6) AS hour__high, round(gb.volume, 6) AS hour__volume, gb.age AS hour__age FROM ticks e LEFT JOIN ga USING (seq) LEFT JOIN gb USING (seq)", *HF))

# 2.13.16.
MODELS = {"moves": ["ret", "momentum"], "shape": ["span", "body"], "size": ["volume", "ret"]}


def stacked(s, d):
    out, _ = K.stacked(X.feature_rows(s, d), MODELS, "y")
    return rounded(out.withColumn("row", F.concat_ws(":", "symbol", F.unix_timestamp("ts"))), *MODELS, "stacked", keys=("row", "fold"), digits=7)


FOLDS = [
    "i0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM f1)",
    "i1 AS (SELECT * FROM (SELECT *, unnest(range(5)) AS fold FROM i0))",
    "i2 AS (SELECT *, fold * (n // 5) AS a, CASE WHEN fold = 4 THEN n ELSE (fold + 1) * (n // 5) END AS b FROM i1)",
    "tr AS (SELECT * FROM i2 WHERE i < a - 5 OR i >= b + 5)", "te AS (SELECT * FROM i2 WHERE i >= a AND i < b)",
]
BETAS = lambda g, m: f"list_transform(range({m - 1}), lambda i: ({exchange_steps(g, m, pivots(m - 1))})[i * {m} + {m}])"
SCORE = lambda b, columns: f"{b}[1] + " + " + ".join(f"{b}[{i + 2}] * {c}" for i, c in enumerate(columns))
ST = [
    *FOLDS, "sg AS (SELECT fold, " + ", ".join(f"{products(['1.0', *own, 'y'])} AS g_{m}" for m, own in MODELS.items()) + " FROM tr GROUP BY fold)",
    "sb AS (SELECT fold, " + ", ".join(f"{BETAS(f'g_{m}', len(own) + 2)} AS b_{m}" for m, own in MODELS.items()) + " FROM sg)",
    "oo AS (SELECT te.row AS row, fold, y, " + ", ".join(f"{SCORE(f'b_{m}', own)} AS {m}" for m, own in MODELS.items()) + " FROM te JOIN sb USING (fold))",
    f"mg AS (SELECT {products(['1.0', *MODELS, 'y'])} AS g FROM oo)", f"mb AS (SELECT {BETAS('g', len(MODELS) + 2)} AS b FROM mg)",
]
add("q_2_13_16_stacking", stacked, over_bars("SELECT row, CAST(fold AS INTEGER) AS fold, " + ", ".join(f"round({m}, 7) AS {m}" for m in MODELS) + f", round({SCORE('b', MODELS)}, 7) AS stacked FROM oo, mb", *X.features_of(*ST)))


# 2.15.2.
def corrected(s, d):
    path = f"{shared_dir(s)}/corrected-{uuid.uuid4().hex}"
    L.corrected_rollup(L.replayed_ticks(s, d), path).awaitTermination()
    return rounded(L.corrected_bars(s, path), "open", "high", "low", "close", keys=("symbol", "ts", "volume", "trade_count"))


add("q_2_15_2_late_data", corrected, over_bars("SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, volume, trade_count, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close FROM bars"))

# 2.15.14: prices of the second half of the month, as a stream, against those of the first.
HALF = "2024-01-16"


def monitored(s, d):
    path = f"{shared_dir(s)}/drift-{uuid.uuid4().hex}"
    stream = L.replayed_ticks(s, d, 4).where(F.col("ts") >= HALF)
    L.drift_monitor(stream, ticks(s, d).where(F.col("ts") < HALF), "symbol", "price", path).awaitTermination()
    return rounded(L.latest_drift(s, path), "ks", keys=("symbol", "n", "alert"), digits=5)


SHARES = f"[{', '.join(str((i + 0.5) / L.POINTS) for i in range(L.POINTS))}]"
DM = f"""WITH {TICKS}, b AS (SELECT symbol, price FROM ticks WHERE ts < TIMESTAMP '{HALF}'), c AS (SELECT symbol, price FROM ticks WHERE ts >= TIMESTAMP '{HALF}'),
q AS (SELECT symbol, quantile_disc(price, {SHARES}) AS q FROM b GROUP BY 1), r AS (SELECT symbol, quantile_disc(price, {SHARES}) AS r, count(*) AS n FROM c GROUP BY 1),
k AS (SELECT symbol, n, list_max(list_transform(q, lambda x: abs(len(list_filter(r, lambda v: v <= x)) - len(list_filter(q, lambda v: v <= x))) / {L.POINTS}.0)) AS ks FROM q JOIN r USING (symbol))
SELECT symbol, n, round(ks, 5) AS ks, CASE WHEN ks > 0.2 THEN 'critical' WHEN ks > 0.1 THEN 'warning' ELSE 'ok' END AS alert FROM k"""
add("q_2_15_14_drift_monitor", monitored, DM)


# 2.15.17: each user has one order a symbol; a tick adds or changes it, sizes that 4 divides take it away.
def order_book(s, d):
    return rounded(drained(O.order_book(O.order_ticks(s, d)), "orders"), "best_bid", "best_ask", "bid_size", "ask_size", keys=("symbol", "seq", "n_orders"))


OB = """WITH o AS (SELECT event_type AS symbol, ts, event_id AS seq, user_id AS oid, user_id % 2 = 0 AS bid, round(value, 1) AS p, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS size FROM events),
z AS (SELECT a.symbol, a.seq, b.oid, max({'ts': b.ts, 'seq': b.seq, 'bid': b.bid, 'p': b.p, 'size': b.size}) AS v FROM o a JOIN o b ON a.symbol = b.symbol AND (b.ts, b.seq) <= (a.ts, a.seq) GROUP BY ALL),
l AS (SELECT symbol, seq, v.bid AS bid, v.p AS p, v.size AS size FROM z WHERE v.size % 4 <> 0),
t AS (SELECT symbol, seq, max(p) FILTER (bid) AS bb, min(p) FILTER (NOT bid) AS ba, count(*) AS n FROM l GROUP BY ALL)
SELECT o.symbol, o.seq, coalesce(n, 0) AS n_orders, round(bb, 6) AS best_bid, round(ba, 6) AS best_ask, round((SELECT sum(size) FROM l WHERE l.symbol = o.symbol AND l.seq = o.seq AND bid AND p = bb), 6) AS bid_size,
round((SELECT sum(size) FROM l WHERE l.symbol = o.symbol AND l.seq = o.seq AND NOT bid AND p = ba), 6) AS ask_size FROM o LEFT JOIN t USING (symbol, seq)"""
add("q_2_15_17_order_book", order_book, OB)
