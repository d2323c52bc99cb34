"""Queries of ordered folds and streams (survey 2.5, 2.8, 2.15) and, where SQL has them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.operators import recurrences as S
from tapewright.plans.build import on_bars, rounded
from tapewright.plans.indicators import step
from tapewright.plans.oracle import TICKS, TR, W, ema, lag, over_bars, roll, rollup, wide
from tapewright.sources.tables import seconds, ticks
from tapewright.streaming import incremental as I

QUERIES: dict = {}
ORACLES: dict = {}
EPOCH = "CAST(epoch(ts) AS BIGINT) AS ts"
SO_FAR = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def add(name, operator, columns, sql=None, *steps, source="bars"):
    QUERIES[name] = on_bars(operator, *columns)
    if sql:
        ORACLES[name] = wide(dict(zip(columns, sql)), source, *steps)


def adaptive_sql(c: str, first: int) -> str:
    """y += c (x - y) from row number `first` (from 1) on."""
    return f"CASE WHEN k >= {first} THEN list_reduce(list({{'y': close, 'c': {c}}}) FILTER (k >= {first}) {SO_FAR}, lambda a, b: {{'y': CASE WHEN b.c IS NULL THEN a.y ELSE a.y + b.c * (b.y - a.y) END, 'c': b.c}}).y END"


NUM = step("n0", {"k": f"row_number() OVER ({W})"})
add("q_2_5_9_parabolic_sar", S.sar, ["sar", "sar_trend"])
add(
    "q_2_5_11_kama", S.kama, ["kama_10"], [adaptive_sql("c", 10)], NUM, step("n1", {"d": f"abs(close - {lag('close')})"}, "n0"),
    step("n2", {"c": f"pow(coalesce(abs(close - {lag('close', 10)}) / nullif({roll('sum(d)', 10)}, 0), 0) * {2 / 3 - 2 / 31!r} + {2 / 31!r}, 2)"}, "n1"), source="n2",
)
SP = lambda a, b, k: f"(max(high) OVER ({W} ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING) - min(low) OVER ({W} ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)) / {k}"
add(
    "q_2_5_12_frama", S.frama, ["frama_16"], [adaptive_sql("c", 16)], NUM, step("n1", {"fa": SP(16, 9, 8), "fb": SP(8, 1, 8), "fe": SP(16, 1, 16)}, "n0"),
    step("n2", {"c": "CASE WHEN k > 16 THEN coalesce(CASE WHEN fa > 0 AND fb > 0 AND fe > 0 THEN greatest(0.01, least(1.0, exp(-4.6 * ((ln(fa + fb) - ln(fe)) / ln(2) - 1)))) END, 1.0) END"}, "n1"), source="n2",
)
add(
    "q_2_5_13_vidya", S.vidya, ["vidya_14"], [adaptive_sql("c", 1)], NUM, step("n1", {"d": f"close - {lag('close')}"}, "n0"), step("n2", {"u": "CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END", "v": "CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END"}, "n1"),
    step("n3", {"c": f"abs(coalesce(({roll('sum(u)', 9)} - {roll('sum(v)', 9)}) / nullif({roll('sum(u)', 9)} + {roll('sum(v)', 9)}, 0), 0)) * {2 / 15!r}"}, "n2"), source="n3",
)
add("q_2_5_15_mcginley", S.mcginley_dynamic, ["mcginley_14"], [f"list_reduce(list(m) FILTER (m IS NOT NULL) {SO_FAR}, lambda y, x: y + (x - y) / (14 * pow(x / y, 4)))"], step("n0", {"m": roll("avg(close)", 20)}), source="n0")
add(
    "q_2_8_71_drawdown_control", S.drawdown_control, ["exposure"],
    [f"list_reduce(list({{'p': close, 'x': close, 's': 1.0::DOUBLE}}) {SO_FAR}, lambda a, b: {{'p': greatest(a.p, b.x), 'x': b.x, 's': CASE WHEN 1 - b.x / greatest(a.p, b.x) >= 0.2 THEN 0.0 WHEN 1 - b.x / greatest(a.p, b.x) >= 0.1 THEN least(a.s, 0.5) WHEN 1 - b.x / greatest(a.p, b.x) < 0.05 THEN 1.0 ELSE a.s END}}).s"],
)
_Z = f"round((close - {roll('avg(close)', 20)}) / nullif({roll('stddev_samp(close)', 20)}, 0), 9)"
add(
    "q_2_8_72_mean_reversion_positions", S.mean_reversion, ["position"],
    [f"list_reduce(list_prepend({{'z': 0.0::DOUBLE, 'p': 0}}, list({{'z': z, 'p': 0}}) {SO_FAR}), lambda a, b: {{'z': b.z, 'p': CASE WHEN b.z IS NULL THEN a.p WHEN a.p = 0 THEN CASE WHEN b.z > 2 AND b.z < 3 THEN -1 WHEN b.z < -2 AND b.z > -3 THEN 1 ELSE 0 END WHEN abs(b.z) < 0.5 OR abs(b.z) > 3 OR a.p * b.z > 0 THEN 0 ELSE a.p END}}).p::DOUBLE"],
    step("z0", {"z": _Z}), source="z0",
)
add(
    "q_2_8_74_minimum_holding", S.minimum_holding, ["held_signal"],
    [f"list_reduce(list({{'x': s, 'h': s, 'a': 0}}) {SO_FAR}, lambda a, b: CASE WHEN b.x <> a.h AND a.a + 1 >= 5 THEN {{'x': b.x, 'h': b.x, 'a': 0}} ELSE {{'x': b.x, 'h': a.h, 'a': a.a + 1}} END).h"],
    step("s0", {"s": f"CAST(coalesce(sign(close - {lag('close')}), 0) AS DOUBLE)"}), source="s0",
)
_BREAK = (
    "{'ready': b.ready, 'c': b.c, 'h': b.h, 'l': b.l, 'u': b.u, 'd': b.d, 'v': b.v, 'a': b.a, 'p': P, 'e': CASE WHEN N THEN b.c ELSE a.e END, 'n': CASE WHEN N THEN b.a ELSE a.n END, 'x': CASE WHEN N THEN CASE WHEN b.c > b.u THEN b.h ELSE b.l END WHEN M AND a.p > 0 THEN greatest(a.x, b.h) WHEN M THEN least(a.x, b.l) ELSE a.x END}"
)
_NEW = "(b.ready AND b.a >= 0.001 AND a.p = 0 AND b.v AND (b.c > b.u OR b.c < b.d))"
_OUT = "((b.c - a.e) * a.p < -1.5 * a.n OR (b.c - CASE WHEN a.p > 0 THEN greatest(a.x, b.h) ELSE least(a.x, b.l) END) * a.p < -1.0 * a.n OR (b.c - a.e) * a.p > 3.0 * a.n)"
_HELD = "(b.ready AND b.a >= 0.001 AND a.p <> 0)"
_POS = f"CASE WHEN {_NEW} THEN CASE WHEN b.c > b.u THEN 1 ELSE -1 END WHEN {_HELD} AND {_OUT} THEN 0 ELSE a.p END"
_ROW = "{'ready': k > 20, 'c': close, 'h': high, 'l': low, 'u': u, 'd': d, 'v': v, 'a': at, 'p': 0, 'e': 0.0::DOUBLE, 'n': 0.0::DOUBLE, 'x': 0.0::DOUBLE}".replace("'a': at", "'a': tra")
add(
    "q_2_8_73_band_breakout", S.band_breakout, ["position"], [f"CASE WHEN k > 20 THEN list_reduce(list({_ROW}) {SO_FAR}, lambda a, b: {_BREAK.replace('P,', f'{_POS},', 1).replace('WHEN N', f'WHEN {_NEW}').replace('WHEN M', f'WHEN {_HELD}')}).p ELSE 0 END"],
    step("t0", {"tr": TR, "k": f"row_number() OVER ({W})", "prev": lag("close")}), step("t1", {"tra": f"round({ema('tr', 14)}, 9)", "v": f"coalesce(volume > 1.5 * {roll('avg(volume)', 20)}, false)"}, "t0"),
    step("t2", {"u": "prev + 2 * tra", "d": "prev - 2 * tra"}, "t1"), source="t2",
)


def stream_rollup(spark, sf_dir):
    df = I.drained(I.rollup_stream(I.tick_stream(spark, sf_dir)), "rollup")
    return rounded(df, "open", "high", "low", "close", keys=("symbol", "ts", "volume", "trade_count"))


def stream_sessions(spark, sf_dir):
    df = I.drained(I.sessions(I.tick_stream(spark, sf_dir)), "sessions")
    return df.select("symbol", F.unix_micros("ts").alias("ts"), F.unix_micros("end_ts").alias("end_ts"), "n", F.round("total", 6).alias("total"))


def stream_features(spark, sf_dir):
    df = I.drained(I.feature_stream(I.timed_tick_stream(spark, sf_dir)), "features")
    return rounded(df, "ema_12", "ema_26", "macd", "mean_20", "sd_20", "low_20", "high_20", keys=("symbol", "seq"))


def stream_equals_batch(spark, sf_dir):
    """Per symbol: rows, and how far stream and batch are apart at most."""
    a = I.drained(I.feature_stream(I.timed_tick_stream(spark, sf_dir)), "features")
    b = I.feature_batch(ticks(spark, sf_dir))
    j = a.join(b.select("symbol", "seq", *[F.col(c).alias(f"b_{c}") for c in I.Features.COLUMNS]), ["symbol", "seq"])
    gap = F.greatest(*[F.abs(F.col(c) - F.col(f"b_{c}")) for c in I.Features.COLUMNS])
    return j.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(gap > 1e-6, 1).otherwise(0)).cast("bigint").alias("differs"))


QUERIES |= {"q_2_15_1_stream_rollup": stream_rollup, "q_2_15_12_stream_sessions": stream_sessions, "q_2_15_10_stream_features": stream_features, "q_2_15_11_stream_equals_batch": stream_equals_batch}
ORACLES["q_2_15_1_stream_rollup"] = over_bars(f"SELECT symbol, {EPOCH}, volume, trade_count, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close FROM bars WHERE ts + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ticks)")
ORACLES["q_2_15_11_stream_equals_batch"] = f"WITH {TICKS} SELECT symbol, count(*) AS n, 0::BIGINT AS differs FROM ticks GROUP BY symbol"
_WT = "PARTITION BY symbol ORDER BY ts, seq"
_f = lambda a: f"list_reduce(list(price) OVER ({_WT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda y, x: y + {a!r} * (x - y))"
_r = lambda f: f"{f}(price) OVER ({_WT} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
ORACLES["q_2_15_10_stream_features"] = f"""WITH {TICKS} SELECT symbol, seq, round(f, 6) AS ema_12, round(g, 6) AS ema_26, round(f - g, 6) AS macd, round(m, 6) AS mean_20, round(s, 6) AS sd_20, round(l, 6) AS low_20, round(h, 6) AS high_20
FROM (SELECT symbol, seq, {_f(2 / 13)} AS f, {_f(2 / 27)} AS g, {_r('avg')} AS m, coalesce({_r('stddev_samp')}, 0) AS s, {_r('min')} AS l, {_r('max')} AS h FROM ticks)"""
ORACLES["q_2_15_12_stream_sessions"] = f"""WITH {TICKS}, a AS (SELECT *, CASE WHEN ts - lag(ts) OVER ({_WT}) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS nw FROM ticks), b AS (SELECT *, sum(nw) OVER ({_WT}) AS k FROM a),
c AS (SELECT symbol, min(ts) AS ts, max(ts) + INTERVAL 15 MINUTE AS e, count(*) AS n, sum(price) AS t FROM b GROUP BY symbol, k) SELECT symbol, epoch_us(ts) AS ts, epoch_us(e) AS end_ts, n, round(t, 6) AS total FROM c WHERE e <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ticks)"""
