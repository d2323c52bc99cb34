"""Queries of cleaning, joins, sets and splits (survey 2.1 to 2.3, 2.10, 2.13) and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.operators import cleaning as C
from tapewright.operators import joins as J
from tapewright.plans.build import on_bars, rounded
from tapewright.plans.indicators import RET, step
from tapewright.plans.oracle import TICKS, W, lag, over_bars, roll, rollup, run, wide
from tapewright.sources.tables import bars, rollup as to_bars, seconds, table, ticks, user_ticks

QUERIES: dict = {}
ORACLES: dict = {}
E = lambda c="ts": f"CAST(epoch({c}) AS BIGINT)"
EPOCH = f"{E()} AS ts"


def add(name, make, sql):
    QUERIES[name] = make
    ORACLES[name] = sql


def on(name, operator, columns, *steps, source="bars", digits=6):
    QUERIES[name] = (lambda op=operator, cols=tuple(columns), dg=digits: lambda s, d: rounded(op(bars(s, d)), *cols, digits=dg))()
    ORACLES[name] = wide(columns, source, *steps, digits=digits)


# Scans and sinks.
add("q_2_1_4_date_range", lambda s, d: rounded(bars(s, d).where("symbol = 'click' and ts >= '2024-01-05' and ts <= '2024-01-10'"), "close"), over_bars(f"SELECT symbol, {EPOCH}, round(close, 6) AS close FROM bars WHERE symbol = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'"))
add("q_2_1_8_info", lambda s, d: bars(s, d).groupBy("symbol").agg(F.unix_timestamp(F.min("ts")).alias("first_ts"), F.unix_timestamp(F.max("ts")).alias("last_ts"), F.count(F.lit(1)).alias("n")), over_bars(f"SELECT symbol, {E('min(ts)')} AS first_ts, {E('max(ts)')} AS last_ts, count(*) AS n FROM bars GROUP BY symbol"))
add("q_2_1_25_half_open_range", lambda s, d: rounded(ticks(s, d).where("symbol = 'view' and ts >= '2024-01-02' and ts < '2024-01-03'"), "price", keys=("symbol", "seq")), f"WITH {TICKS} SELECT symbol, seq, round(price, 6) AS price FROM ticks WHERE symbol = 'view' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03'")
add("q_2_1_28_latest_bar", lambda s, d: rounded(bars(s, d).groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "volume"), "ts").alias("x")).select("symbol", "x.*"), "close", keys=("symbol", "ts", "volume")), over_bars(f"SELECT symbol, {EPOCH}, volume, round(close, 6) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"))
add("q_2_1_29_distinct_symbols", lambda s, d: ticks(s, d).select("symbol").distinct(), f"WITH {TICKS} SELECT DISTINCT symbol FROM ticks")
add("q_2_1_7_panel", lambda s, d: to_bars(ticks(s, d), "1 day").groupBy("ts").pivot("symbol", ["click", "error", "purchase", "signup", "view"]).agg(F.first(F.round("close", 6))).withColumn("ts", F.unix_timestamp("ts")), None)
ORACLES["q_2_1_7_panel"] = "WITH " + TICKS + ", " + rollup("db", "1 DAY") + f" SELECT {E()} AS ts, " + ", ".join(f"max(CASE WHEN symbol = '{x}' THEN round(close, 6) END) AS \"{x}\"" for x in ("click", "error", "purchase", "signup", "view")) + " FROM db GROUP BY ts"
add("q_2_1_22_retention", lambda s, d: rounded(ticks(s, d).where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")), "price", keys=("symbol", "seq")), f"WITH {TICKS} SELECT symbol, seq, round(price, 6) AS price FROM ticks WHERE ts >= TIMESTAMP '2024-01-20'")


def _two_writes(s, d):
    b = to_bars(ticks(s, d), "1 hour").select("symbol", "ts", "close")
    return b.where("ts < '2024-01-20'"), b.where("ts >= '2024-01-10'").withColumn("close", F.col("close") + 1)


UP = "WITH " + TICKS + ", " + rollup("hb", "1 HOUR") + ", a AS (SELECT symbol, ts, close FROM hb WHERE ts < TIMESTAMP '2024-01-20'), b AS (SELECT symbol, ts, close + 1 AS close FROM hb WHERE ts >= TIMESTAMP '2024-01-10')\n"
add("q_2_1_24_insert_first_wins", lambda s, d: rounded(J.upsert(*_two_writes(s, d), ["symbol", "ts"]), "close"), UP + f"SELECT symbol, {EPOCH}, round(close, 6) AS close FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.symbol = b.symbol AND a.ts = b.ts))")
add("q_2_1_35_upsert_last_wins", lambda s, d: rounded(J.upsert(*_two_writes(s, d), ["symbol", "ts"], first_wins=False), "close"), UP + f"SELECT symbol, {EPOCH}, round(close, 6) AS close FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.symbol = b.symbol AND a.ts = b.ts))")
add(
    "q_2_1_31_migration_check", lambda s, d: _two_writes(s, d)[0].groupBy("symbol").agg(F.count(F.lit(1)).alias("a")).join(_two_writes(s, d)[1].groupBy("symbol").agg(F.count(F.lit(1)).alias("b")), "symbol", "full_outer").select("symbol", "a", "b", F.when(F.col("a").eqNullSafe(F.col("b")), 1).otherwise(0).cast("bigint").alias("matches")),
    UP + "SELECT coalesce(x.symbol, y.symbol) AS symbol, x.n AS a, y.n AS b, CAST(CASE WHEN x.n IS NOT DISTINCT FROM y.n THEN 1 ELSE 0 END AS BIGINT) AS matches FROM (SELECT symbol, count(*) AS n FROM a GROUP BY 1) x FULL JOIN (SELECT symbol, count(*) AS n FROM b GROUP BY 1) y ON x.symbol = y.symbol",
)
add(
    "q_2_1_32_universe_metadata", lambda s, d: rounded(to_bars(user_ticks(s, d), "1 day").groupBy("symbol").agg(F.min("ts").alias("ts"), F.unix_timestamp(F.max("ts")).alias("last_ts"), F.count(F.lit(1)).alias("n_bars"), F.avg(F.col("close") * F.col("volume")).alias("adv")), "adv", keys=("symbol", "ts", "last_ts", "n_bars"), digits=4),
    "WITH " + TICKS.replace("event_type AS symbol", "user_id AS symbol") + ", " + rollup("ub", "1 DAY") + f" SELECT symbol, {E('min(ts)')} AS ts, {E('max(ts)')} AS last_ts, count(*) AS n_bars, round(avg(close * volume), 4) AS adv FROM ub GROUP BY symbol",
)
add(
    "q_2_1_34_long_features", lambda s, d: rounded(bars(s, d).withColumns({"sma_5": R.mean("close", 5), "r": R.pct("close")}).unpivot(["symbol", "ts"], ["sma_5", "r"], "feature_name", "value").where("value is not null"), "value", keys=("symbol", "ts", "feature_name")),
    over_bars(f"SELECT symbol, {EPOCH}, 'sma_5' AS feature_name, round(m, 6) AS value FROM l WHERE m IS NOT NULL UNION ALL SELECT symbol, {EPOCH}, 'r', round(r, 6) FROM l WHERE r IS NOT NULL", step("l", {"m": roll("avg(close)", 5), "r": RET(1)})),
)

# Validation and repair.
CK = over_bars(
    """SELECT symbol, n_rows, n_jumps, n_gaps, n_volume_outliers, round(zero_volume_pct, 6) AS zero_volume_pct FROM c""",
    step("c0", {"r": RET(1), "gap": f"{E()} - {E(lag('ts'))}", "m": "avg(volume) OVER (PARTITION BY symbol)", "s": "stddev_samp(volume) OVER (PARTITION BY symbol)"}),
    "c AS (SELECT symbol, count(*) AS n_rows, CAST(sum(CASE WHEN abs(r) * 100 > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_jumps, CAST(sum(CASE WHEN gap > 3600 AND gap < 54000 THEN 1 ELSE 0 END) AS BIGINT) AS n_gaps, CAST(sum(CASE WHEN volume > m + 5 * s THEN 1 ELSE 0 END) AS BIGINT) AS n_volume_outliers, avg(CASE WHEN volume = 0 THEN 100.0 ELSE 0 END) AS zero_volume_pct FROM c0 GROUP BY symbol)",
)
add("q_2_2_9_validation_report", lambda s, d: rounded(C.checks(bars(s, d)), "zero_volume_pct", keys=("symbol", "n_rows", "n_jumps", "n_gaps", "n_volume_outliers")), CK)
add("q_2_2_4_jumps", lambda s, d: rounded(C.jumps(bars(s, d)), "jump_pct"), over_bars(f"SELECT symbol, {EPOCH}, round(100 * r, 6) AS jump_pct FROM j WHERE abs(100 * r) > 50", step("j", {"r": RET(1)})))
add(
    "q_2_2_10_splits", lambda s, d: rounded(C.splits(bars(s, d)), "move", keys=("symbol", "ts", "kind")),
    over_bars(f"SELECT symbol, {EPOCH}, CASE WHEN mv < -0.4 THEN 'forward' ELSE 'reverse' END AS kind, round(mv, 6) AS move FROM j WHERE mv < -0.4 OR mv > 1.5", step("j", {"mv": f"open / nullif({lag('close')}, 0) - 1"})),
)
add(
    "q_2_2_11_dividends", lambda s, d: rounded(C.dividends(bars(s, d)), "drop", "amount", digits=9),
    over_bars(f"SELECT symbol, {EPOCH}, round(dr, 9) AS drop, round(dr * p, 9) AS amount FROM j WHERE dr > 0.005 AND dr < 0.10", step("j", {"p": lag("close"), "dr": f"1 - open / nullif({lag('close')}, 0)"})),
)
HO = step("h", {"x": "CASE WHEN CAST(epoch(ts) / 900 AS BIGINT) % 7 <> 0 THEN close END"})
on(
    "q_2_2_20_fill", lambda b: C.fill(C.with_holes(b)), {"close_filled": f"coalesce(f, first_value(f IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING))"},
    HO, step("h1", {"f": f"last_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)"}, "h"), source="h1",
)
IV = [HO, step("h1", {"t": f"CASE WHEN x IS NOT NULL THEN {E()} END"}, "h"), step("h2", {f"{n}{v}": f"{f}({v} IGNORE NULLS) OVER ({W} ROWS BETWEEN {r})" for n, f, r in (("a", "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"), ("b", "first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")) for v in "xt"}, "h1")]
on("q_2_2_21_interpolate", lambda b: C.interpolate(C.with_holes(b)), {"close_interpolated": f"coalesce(x, ax + (bx - ax) * ({E()} - at) / nullif(bt - at, 0))".replace(" at)", " \"at\")").replace("- at,", "- \"at\",")}, *IV, source="h2")
on("q_2_2_22_repair", lambda b: C.repair(b.withColumn("high", F.least("open", "close"))), {"high": "greatest(open, least(open, close), low, close)", "low": "least(open, greatest(open, least(open, close), low, close), low, close)"})
add(
    "q_2_2_24_first_bars", lambda s, d: rounded(C.first_rows(ticks(s, d).withColumn("hour", F.unix_timestamp(F.date_trunc("hour", "ts"))), "symbol", "hour"), "price", keys=("symbol", "hour", "seq")),
    f"WITH {TICKS} SELECT symbol, {E('date_trunc(chr(104) || chr(111) || chr(117) || chr(114), ts)')} AS hour, seq, round(price, 6) AS price FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol, date_trunc('hour', ts) ORDER BY seq) = 1".replace("chr(104) || chr(111) || chr(117) || chr(114)", "'hour'"),
)
CL = [
    step("r0", {"r": RET(1), "pc": lag("close")}), step("r1", {"lo": "avg(r) OVER (PARTITION BY symbol) - 3 * stddev_samp(r) OVER (PARTITION BY symbol)", "hi": "avg(r) OVER (PARTITION BY symbol) + 3 * stddev_samp(r) OVER (PARTITION BY symbol)"}, "r0"),
    step("r2", {"cr": "CASE WHEN r IS NOT NULL THEN greatest(least(r, hi), lo) END", "o": "CASE WHEN r > hi OR r < lo THEN 1 ELSE 0 END"}, "r1"), step("r3", {"nw": f"CASE WHEN o IS DISTINCT FROM {lag('o')} THEN 1 ELSE 0 END"}, "r2"), step("r4", {"rn": run("sum(nw)")}, "r3"),
    step("r5", {"g": "first_value(pc) OVER (PARTITION BY symbol, rn ORDER BY ts) * exp(sum(ln(greatest(1 + cr, 1e-9))) OVER (PARTITION BY symbol, rn ORDER BY ts))"}, "r4"),
]
on("q_2_2_23_clip_returns", C.clip_returns, {"close_clipped": "CASE WHEN o = 1 THEN g ELSE close END"}, *CL, source="r5", digits=5)
TRAIN = "p AS (SELECT symbol AS s0, " + ", ".join(f"quantile_cont(close, {q}) AS p{int(q * 100):02d}" for q in (0.01, 0.25, 0.5, 0.75, 0.99)) + ", avg(close) AS mu, stddev_pop(close) AS sp, min(close) AS lo, max(close) AS hi FROM bars WHERE ts < TIMESTAMP '2024-01-20' GROUP BY symbol)"
PP = [TRAIN, "q AS (SELECT * FROM bars JOIN p ON symbol = s0)"]
_pre = lambda b: C.preprocess(b.where("ts < '2024-01-20'"), b, "close")
on("q_2_2_27_winsorize", _pre, {"winsorised": "greatest(least(close, p99), p01)"}, *PP, source="q")
on("q_2_2_28_sigma_clip", _pre, {"sigma_clipped": "greatest(least(close, mu + 5 * sp), mu - 5 * sp)"}, *PP, source="q")
on("q_2_2_30_scalers", _pre, {"standard": "(close - mu) / nullif(sp, 0)", "robust": "(close - p50) / nullif(p75 - p25, 0)", "min_max": "(close - lo) / nullif(hi - lo, 0)"}, *PP, source="q")
on(
    "q_2_2_26_infinities", lambda b: C.infinities(b.withColumn("z", F.when(F.col("volume") % 10 == 0, F.lit(float("inf"))).otherwise(R.pct("close"))), "z"),
    {"z_finite": "CASE WHEN volume % 10 = 0 THEN 1.5 * max(CASE WHEN volume % 10 <> 0 THEN r END) OVER (PARTITION BY symbol) ELSE r END"}, step("r0", {"r": RET(1)}), source="r0",
)
MN = "(hour(ts) * 60 + minute(ts))"
on(
    "q_2_2_34_sessions", C.calendar,
    {"session": f"CASE WHEN {MN} >= 240 AND {MN} < 570 THEN 0.0 WHEN {MN} >= 570 AND {MN} < 960 THEN 1.0 WHEN {MN} >= 960 AND {MN} < 1200 THEN 2.0 ELSE -1.0 END", "is_regular": f"CASE WHEN {MN} >= 570 AND {MN} < 960 THEN 1.0 ELSE 0.0 END"},
)
CY = {}
for _n, _x, _m in (("hour", "hour(ts)", 24), ("minute", "minute(ts)", 60), ("weekday", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12), ("quarter", "quarter(ts)", 4)):
    CY |= {f"{_n}_sin": f"sin({2 * math.pi!r} * {_x} / {_m})", f"{_n}_cos": f"cos({2 * math.pi!r} * {_x} / {_m})"}
on("q_2_2_35_cyclical_time", C.calendar, CY)
on("q_2_2_36_session_distances", C.calendar, {"minutes_to_open": f"CAST(570 - {MN} AS DOUBLE)", "minutes_to_close": f"CAST(960 - {MN} AS DOUBLE)"})
on("q_2_2_37_session_boundaries", C.calendar, {"first_half_hour": f"CASE WHEN {MN} >= 570 AND {MN} < 600 THEN 1.0 ELSE 0.0 END", "last_half_hour": f"CASE WHEN {MN} >= 930 AND {MN} < 960 THEN 1.0 ELSE 0.0 END"})
# The third Friday: days to the first Friday of the month, plus two weeks.
TF = "(CAST(date_trunc('month', ts) AS DATE) + CAST((12 - isodow(date_trunc('month', ts))) % 7 + 14 AS INTEGER))"
on("q_2_2_38_expiry_week", C.calendar, {"expiry_week": f"CASE WHEN CAST(ts AS DATE) >= {TF} - 4 AND CAST(ts AS DATE) <= {TF} THEN 1.0 ELSE 0.0 END"})
on("q_2_2_39_rate_week", C.calendar, {"rate_week": "CASE WHEN month(ts) IN (1, 3, 5, 6, 7, 9, 11, 12) AND day(ts) BETWEEN 15 AND 21 AND isodow(ts) <= 5 THEN 1.0 ELSE 0.0 END"})
add(
    "q_2_2_40_trading_calendar", lambda s, d: C.trading_calendar(s, "2024-01-01", "2024-01-31").join(bars(s, d).select("ts").distinct().withColumn("has_bar", F.lit(1)), "ts", "left").select(seconds(), F.coalesce("has_bar", F.lit(0)).cast("bigint").alias("has_bar")),
    over_bars(f"SELECT {E('t')} AS ts, CAST(CASE WHEN b.ts IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS has_bar FROM (SELECT d + INTERVAL 15 MINUTE * k AS t FROM (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY)) AS d), (SELECT unnest(range(38, 65)) AS k) WHERE isodow(d) <= 5) c LEFT JOIN (SELECT DISTINCT ts FROM bars) b ON c.t = b.ts"),
)


# As-of and interval joins.
def _clicks_views(s, d):
    t = ticks(s, d).withColumn("symbol", F.col("symbol"))
    e = table(s, d, "events").select(F.col("user_id").alias("symbol"), "ts", "event_id", "event_type", "value")
    return e.where("event_type = 'click'").select("symbol", "ts", "event_id"), e.where("event_type = 'view'").select("symbol", "ts", F.col("value").alias("feature"))


AO = "SELECT c.user_id AS symbol, c.event_id, round({v}, 6) AS feature FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts"
add("q_2_3_22_as_of", lambda s, d: rounded(J.as_of(*_clicks_views(s, d), "feature"), "feature", keys=("symbol", "event_id")), AO.format(v="v.value"))
add("q_2_3_19_as_of_ttl", lambda s, d: rounded(J.as_of(*_clicks_views(s, d), "feature", ttl_seconds=86400), "feature", keys=("symbol", "event_id")), AO.format(v="CASE WHEN epoch(c.ts)::BIGINT - epoch(v.ts)::BIGINT <= 86400 THEN v.value END").replace("epoch(c.ts)::BIGINT", "CAST(floor(epoch(c.ts)) AS BIGINT)").replace("epoch(v.ts)::BIGINT", "CAST(floor(epoch(v.ts)) AS BIGINT)"))
add(
    "q_2_3_21_online_features", lambda s, d: rounded(_clicks_views(s, d)[1].groupBy("symbol").agg(F.max_by("feature", "ts").alias("feature")), "feature", keys=("symbol",)),
    "SELECT user_id AS symbol, round(arg_max(value, ts), 6) AS feature FROM events WHERE event_type = 'view' GROUP BY 1",
)


def _dim(s, d):
    """Listing interval of each user symbol: first to last tick, open-ended for every third."""
    g = user_ticks(s, d).groupBy("symbol").agg(F.to_date(F.min("ts")).alias("listing"), F.to_date(F.max("ts")).alias("delist"))
    return g.withColumn("delist", F.when(F.col("symbol") % 3 != 0, F.col("delist")))


def _dates(s, d):
    return user_ticks(s, d).select(F.to_date("ts").alias("d")).distinct()


DIM = "WITH dim AS (SELECT user_id AS symbol, CAST(min(ts) AS DATE) AS listing, CASE WHEN user_id % 3 <> 0 THEN CAST(max(ts) AS DATE) END AS delist FROM events GROUP BY user_id), ds AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)\n"
day = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")).alias(c)
add("q_2_3_2_universe_history", lambda s, d: J.active(_dim(s, d), _dates(s, d)).groupBy(day("d")).agg(F.count(F.lit(1)).alias("n")), DIM + f"SELECT {E('d')} AS d, count(*) AS n FROM ds JOIN dim ON listing <= d AND (delist IS NULL OR d <= delist) GROUP BY ds.d")
add("q_2_3_1_universe_as_of", lambda s, d: J.active(_dim(s, d), _dates(s, d).where("d = '2024-01-15'")).select("symbol"), DIM + "SELECT symbol FROM dim WHERE listing <= DATE '2024-01-15' AND (delist IS NULL OR delist >= DATE '2024-01-15')")
add("q_2_3_4_delistings", lambda s, d: _dim(s, d).where("delist between '2024-01-20' and '2024-01-30'").select("symbol", day("delist")), DIM + f"SELECT symbol, {E('delist')} AS delist FROM dim WHERE delist BETWEEN DATE '2024-01-20' AND DATE '2024-01-30'")
add(
    "q_2_3_6_point_in_time_load", lambda s, d: rounded(bars(s, d).where("ts >= '2024-01-10' and ts <= '2024-01-15'").join(ticks(s, d).where("ts <= '2024-01-15'").select("symbol").distinct(), "symbol", "left_semi"), "close"),
    over_bars(f"SELECT symbol, {EPOCH}, round(close, 6) AS close FROM bars WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-15' AND symbol IN (SELECT symbol FROM ticks WHERE ts <= TIMESTAMP '2024-01-15')"),
)


def _actions(s, d):
    """Actions at the overnight moves of the bars: splits where the open fell by over 40 %, dividends at small drops."""
    b = bars(s, d).withColumn("close_before", R.lag("close")).withColumn("move", F.try_divide(F.col("open"), F.col("close_before")) - 1)
    kind = F.when(F.col("move") < -0.9, "split").when(F.col("move") > 9, "reverse_split").when(F.col("move").between(-0.05, -0.005), "dividend")
    a = b.withColumn("kind", kind).where("kind is not null")
    ratio = F.when(F.col("kind") == "split", F.lit(2.0)).when(F.col("kind") == "reverse_split", F.lit(3.0)).otherwise(1.0)
    return J.factors(a.select("symbol", F.col("ts").alias("ex_ts"), "kind", ratio.alias("ratio"), (-F.col("move") * F.col("close_before")).alias("amount"), "close_before"))


AC = [
    step("a0", {"cb": lag("close"), "mv": f"open / nullif({lag('close')}, 0) - 1"}), "a1 AS (SELECT symbol, ts, cb, mv, CASE WHEN mv < -0.9 THEN 'split' WHEN mv > 9 THEN 'reverse_split' WHEN mv BETWEEN -0.05 AND -0.005 THEN 'dividend' END AS kind FROM a0)",
    "a2 AS (SELECT symbol, ts AS ex, kind, CASE kind WHEN 'split' THEN 0.5 WHEN 'reverse_split' THEN 3.0 ELSE (cb + mv * cb) / cb END AS pf, CASE kind WHEN 'split' THEN 2.0 WHEN 'reverse_split' THEN 1.0 / 3 ELSE 1.0 END AS vf FROM a1 WHERE kind IS NOT NULL)",
]
add(
    "q_2_3_16_action_factors", lambda s, d: rounded(_actions(s, d).withColumn("ts", F.col("ex_ts")), "price_factor", "volume_factor", keys=("symbol", "ts", "kind")),
    over_bars(f"SELECT symbol, {E('ex')} AS ts, kind, round(pf, 6) AS price_factor, round(vf, 6) AS volume_factor FROM a2", *AC),
)
AD = "ad AS (SELECT b.symbol, b.ts, min(b.close) AS close, min(b.volume) AS volume, coalesce(sum(ln(a2.pf)), 0) AS lp, coalesce(sum(ln(a2.vf)), 0) AS lv, count(a2.ex) AS n FROM bars b LEFT JOIN a2 ON a2.symbol = b.symbol AND b.ts < a2.ex GROUP BY 1, 2)"
add(
    "q_2_3_15_adjusted_prices", lambda s, d: rounded(J.adjusted(bars(s, d), _actions(s, d)).withColumns({"log_price_factor": F.ln("price_factor"), "log_volume_factor": F.ln("volume_factor")}), "log_price_factor", "log_volume_factor", digits=5),
    over_bars(f"SELECT symbol, {EPOCH}, round(lp, 5) AS log_price_factor, round(lv, 5) AS log_volume_factor FROM ad", *AC, AD),
)
add("q_2_3_17_cumulative_factor", lambda s, d: rounded(_actions(s, d).groupBy("symbol").agg(F.sum(F.ln("price_factor")).alias("log_factor"), F.count(F.lit(1)).alias("n")), "log_factor", keys=("symbol", "n"), digits=5), over_bars("SELECT symbol, count(*) AS n, round(sum(ln(pf)), 5) AS log_factor FROM a2 GROUP BY symbol", *AC))
add(
    "q_2_3_8_walk_forward_windows",
    lambda s, d: J.range_join(bars(s, d).select("symbol", "ts"), ticks(s, d).select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-29").cast("timestamp"), F.expr("interval 7 days"))).alias("end")).withColumn("start", F.col("end") - F.expr("interval 3 days")), "symbol", "ts", "start", "end").groupBy("symbol", F.unix_timestamp("end").alias("as_of")).agg(F.count(F.lit(1)).alias("n")),
    over_bars(f"SELECT symbol, {E('e')} AS as_of, count(*) AS n FROM bars JOIN (SELECT unnest(range(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-30', INTERVAL 7 DAY)) AS e) ON ts BETWEEN e - INTERVAL 3 DAY AND e GROUP BY 1, 2"),
)
add("q_2_3_14_sectors", lambda s, d: table(s, d, "part").groupBy(F.col("p_brand").alias("sector")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("p_partkey")), 1, 5).cast("array<string>"), ",").alias("first_parts")), "SELECT p_brand AS sector, count(*) AS n, array_to_string(list_sort(list(p_partkey))[1:5], ',') AS first_parts FROM part GROUP BY 1")

# Sets.
add("q_2_10_3_common_times", lambda s, d: bars(s, d).where("symbol = 'click'").select("ts").intersect(bars(s, d).where("symbol = 'view'").select("ts")).select(seconds()), over_bars(f"SELECT {EPOCH} FROM (SELECT ts FROM bars WHERE symbol = 'click' INTERSECT SELECT ts FROM bars WHERE symbol = 'view')"))
add("q_2_10_3_missing_times", lambda s, d: bars(s, d).where("symbol = 'click'").select("ts").exceptAll(bars(s, d).where("symbol = 'view'").select("ts")).select(seconds()), over_bars(f"SELECT {EPOCH} FROM (SELECT ts FROM bars WHERE symbol = 'click' EXCEPT SELECT ts FROM bars WHERE symbol = 'view')"))
add(
    "q_2_10_1_diagonal_union", lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal").unionByName(table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), "s_acctbal"), allowMissingColumns=True),
    "SELECT c_custkey AS key, c_acctbal, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier",
)

# Splits and folds.
_ix = step("ix", {"k": f"row_number() OVER ({W}) - 1", "n": "count(*) OVER (PARTITION BY symbol)"})
FO = [_ix, "fo AS (SELECT symbol, ts, k, f, CASE WHEN k >= f * (n // 5) AND k < CASE WHEN f = 4 THEN n ELSE (f + 1) * (n // 5) END THEN 'test' WHEN k >= f * (n // 5) - 10 AND k < f * (n // 5) THEN 'none' WHEN k >= CASE WHEN f = 4 THEN n ELSE (f + 1) * (n // 5) END AND k < CASE WHEN f = 4 THEN n ELSE (f + 1) * (n // 5) END + 20 THEN 'none' ELSE 'train' END AS role FROM ix, (SELECT unnest(range(5)) AS f))"]
add("q_2_13_3_purged_kfold", lambda s, d: J.folds(bars(s, d), 5, 10, 20).groupBy("symbol", F.col("fold").cast("bigint").alias("fold"), "role").agg(F.count(F.lit(1)).alias("n"), F.min("row").cast("bigint").alias("first_row"), F.max("row").cast("bigint").alias("last_row")), over_bars("SELECT symbol, CAST(f AS BIGINT) AS fold, role, count(*) AS n, min(k) AS first_row, max(k) AS last_row FROM fo GROUP BY 1, 2, 3", *FO))
WFS = lambda first: [_ix, f"wf AS (SELECT symbol, ts, k, f, CASE WHEN k >= {first} AND k < f * 100 + 300 THEN 'train' WHEN k >= f * 100 + 310 AND k < f * 100 + 410 THEN 'test' END AS role FROM ix, LATERAL (SELECT unnest(range((n - 410) // 100 + 1)) AS f))"]
WFQ = "SELECT symbol, CAST(f AS BIGINT) AS fold, CAST(sum(CASE WHEN role = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_train, CAST(sum(CASE WHEN role = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS n_test, min(CASE WHEN role = 'test' THEN k END) - max(CASE WHEN role = 'train' THEN k END) - 1 AS gap FROM wf WHERE role IS NOT NULL GROUP BY 1, 2"
for _name, _exp, _first in (("q_2_13_2_walk_forward", False, "f * 100"), ("q_2_13_5_expanding", True, "0")):
    add(_name, lambda s, d, e=_exp: J.fold_audit(J.walk_forward(bars(s, d), 300, 10, 100, 100, e)).select("symbol", F.col("fold").cast("bigint").alias("fold"), "n_train", "n_test", F.col("gap").cast("bigint").alias("gap")), over_bars(WFQ, *WFS(_first)))
add("q_2_13_8_three_way_split", lambda s, d: J.share_split(bars(s, d)).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.unix_timestamp(F.min("ts")).alias("first_ts")), over_bars(f"SELECT symbol, CASE WHEN k / n < 0.7 THEN 'train' WHEN k / n < 0.7 + 0.15 THEN 'validation' ELSE 'test' END AS part, count(*) AS n, {E('min(ts)')} AS first_ts FROM ix GROUP BY 1, 2", _ix.replace("count(*) OVER (PARTITION BY symbol) AS n", "CAST(count(*) OVER (PARTITION BY symbol) AS DOUBLE) AS n")))
