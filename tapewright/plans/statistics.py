"""Queries of rolling statistics, microstructure and regimes (survey 2.8) and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tapewright.operators import microstructure as M
from tapewright.operators import statistics as S
from tapewright.plans.build import on_bars, rounded
from tapewright.plans.indicators import RET, step
from tapewright.plans.oracle import TR, W, lag, over_bars, roll, run, wide
from tapewright.sources.tables import bars, seconds

QUERIES: dict = {}
ORACLES: dict = {}
R0 = step("r0", {"r": RET(1)})


def add(name, operator, columns, *steps, source="bars", digits=6):
    QUERIES[name] = on_bars(operator, *columns)
    ORACLES[name] = wide(columns, source, *steps, digits=digits)


def table(name, make, sql):
    """A query whose result is not one row per bar."""
    QUERIES[name] = make
    ORACLES[name] = sql


SK = "avg({x} * {x} * {x})"
add(
    "q_2_8_1_moments", S.moments, {"skew_20": f"CASE WHEN n = 20 THEN m3 / nullif(pow(m2, 1.5), 0) * {math.sqrt(20 * 19) / 18!r} END", "kurt_20": f"CASE WHEN n = 20 THEN (21 * (m4 / nullif(m2 * m2, 0) - 3) + 6) * {19 / (18 * 17)!r} END"},
    R0, step("k0", {"n": f"count(r) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "v": f"list(r) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "mu": f"avg(r) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"}, "r0"),
    step("k1", {f"m{p}": f"list_sum(list_transform(v, lambda x: pow(x - mu, {p}))) / 20" for p in (2, 3, 4)}, "k0"), source="k1",
)
Z = lambda x: f"({x} - {roll(f'avg({x})', 20)}) / nullif({roll(f'stddev_samp({x})', 20)}, 0)"
add("q_2_8_2_zscores", S.zscores, {"price_z_20": Z("close"), "volume_z_20": Z("volume")})
AC = lambda k: f"CASE WHEN count(r{k}) OVER f{k} >= {50 - k} THEN covar_pop(r, r{k}) OVER f{k} / nullif(stddev_pop(r) OVER f{k} * stddev_pop(r{k}) OVER f{k}, 0) END".replace(f"f{k}", f"({W} ROWS BETWEEN {49 - k} PRECEDING AND CURRENT ROW)")
add("q_2_8_3_autocorrelation", S.autocorrelation, {f"autocorr_{k}": AC(k) for k in (1, 5, 10)}, R0, step("r1", {f"r{k}": lag("r", k) for k in (1, 5, 10)}, "r0"), source="r1")
F100 = f"({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
add(
    "q_2_8_4_hurst", S.hurst, {"hurst_100": f"CASE WHEN n = 100 AND (list_max(c) - list_min(c)) / nullif(s, 0) > 0 THEN ln((list_max(c) - list_min(c)) / s) / {math.log(100)!r} END"},
    R0, step("h0", {"n": f"count(r) OVER {F100}", "v": f"list(r) OVER {F100}", "m": f"avg(r) OVER {F100}", "s": f"stddev_pop(r) OVER {F100}"}, "r0"),
    step("h1", {"c": "list_transform(range(1, 101), lambda k: list_sum(v[1:k]) - k * m)"}, "h0"), source="h1",
)
F60 = f"({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
add(
    "q_2_8_6_market_beta", S.market_beta,
    {"market_corr_60": f"CASE WHEN count(r) OVER {F60} = 60 THEN covar_samp(r, m) OVER {F60} / nullif(sqrt(var_samp(m) OVER {F60} * var_samp(r) OVER {F60}), 0) END", "market_beta_60": f"CASE WHEN count(r) OVER {F60} = 60 THEN covar_samp(r, m) OVER {F60} / nullif(var_samp(m) OVER {F60}, 0) END"},
    R0, step("m0", {"m": "CASE WHEN r IS NOT NULL THEN avg(r) OVER (PARTITION BY ts) END"}, "r0"), source="m0",
)
FW = S.fractional_weights(0.8, 1e-3)
FD = " + ".join(f"{w!r} * coalesce({'close' if k == 0 else lag('close', k)}, 0)" for k, w in enumerate(FW))
add("q_2_8_10_fractional_fixed", S.fractional_difference, {"frac_diff": f"CASE WHEN row_number() OVER ({W}) >= {len(FW)} THEN {FD} END"})
add("q_2_8_11_fractional_expanding", lambda b: S.fractional_difference(b, expanding=True), {"frac_diff": FD})
F252 = f"({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
PR = [R0, step("p0", {"v": f"round({roll('stddev_samp(r)', 20)}, 12)"}, "r0"), step("p1", {"l": f"list(v) FILTER (v IS NOT NULL) OVER {F252}"}, "p0"),
      step("p2", {"p": "CASE WHEN v IS NOT NULL AND len(l) >= 20 THEN 100.0 * len(list_filter(l, lambda x: x < v)) / len(l) END"}, "p1")]
add("q_2_8_53_volatility_percentile", S.percentile_regime, {"vol_percentile": "p"}, *PR, source="p2")
LABEL = "CASE WHEN p < 10 THEN 'very_low' WHEN p < 25 THEN 'low' WHEN p < 75 THEN 'normal' WHEN p < 90 THEN 'high' WHEN p IS NOT NULL THEN 'extreme' END"
table(
    "q_2_8_54_volatility_labels", lambda s, d: S.percentile_regime(bars(s, d)).select("symbol", seconds(), "vol_regime"),
    over_bars(f"SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, {LABEL} AS vol_regime FROM p2", *PR),
)
TG = [
    step("t0", {"tr": TR, "up": f"high - {lag('high')}", "dn": f"{lag('low')} - low"}),
    step("t1", {"dp": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END", "dm": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END"}, "t0"),
    step("t2", {"p": f"100 * {roll('avg(dp)', 14)} / nullif({roll('avg(tr)', 14)}, 0)", "m": f"100 * {roll('avg(dm)', 14)} / nullif({roll('avg(tr)', 14)}, 0)"}, "t1"),
    step("t3", {"dx": "100 * abs(p - m) / nullif(p + m, 0)"}, "t2"), step("t4", {"adx": f"coalesce({roll('avg(dx)', 14)}, 0.0)", "f": roll("avg(close)", 20), "s": roll("avg(close)", 50)}, "t3"),
    step("t5", {"g": "CASE WHEN adx > 25 AND f > s THEN 2 WHEN adx > 25 AND f < s THEN 0 ELSE 1 END"}, "t4"),
]
add("q_2_8_50_trend_regime", S.trend_regime, {"trend_regime": "CAST(g AS DOUBLE)"}, *TG, source="t5")
add("q_2_8_83_rolling_adx", S.trend_regime, {"adx_mean": "adx"}, *TG, source="t5")
RUNS = [step("u0", {"nw": f"CASE WHEN g IS DISTINCT FROM {lag('g')} THEN 1 ELSE 0 END"}, "t5"), step("u1", {"rn": run("sum(nw)")}, "u0"), step("u2", {"k": "row_number() OVER (PARTITION BY symbol, rn ORDER BY ts)"}, "u1")]
add(
    "q_2_8_52_regime_duration", lambda b: S.regime_runs(S.trend_regime(b), "trend_regime"), {"bars_in_regime": "CAST(k AS DOUBLE)", "regime_changed": "CASE WHEN k = 1 AND rn > 1 THEN 1.0 ELSE 0.0 END"},
    *TG, *RUNS, source="u2",
)
CU = [R0, "c0 AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, (r - avg(r) OVER (PARTITION BY symbol)) / nullif(stddev_pop(r) OVER (PARTITION BY symbol), 0) AS z, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS t FROM r0 WHERE r IS NOT NULL)",
      step("c1", {"cu": f"{run('sum(z)')} / sqrt(n)", "bd": "1.36 * sqrt(t / n)"}, "c0")]
add("q_2_8_60_cusum", S.cusum, {"cusum": "cu", "cusum_bound": "bd"}, *CU, source="c1")
table(
    "q_2_8_62_first_break", lambda s, d: S.cusum(bars(s, d)).where("crossed = 1").groupBy("symbol").agg(F.unix_timestamp(F.min("ts")).alias("first_ts"), F.count(F.lit(1)).alias("n_crossed")),
    over_bars("SELECT symbol, CAST(epoch(min(ts)) AS BIGINT) AS first_ts, count(*) AS n_crossed FROM c1 WHERE abs(cu) > bd GROUP BY symbol", *CU),
)
PAST = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
add(
    "q_2_8_61_cusum_recursive", S.recursive_cusum, {"cusum_recursive": f"CASE WHEN z IS NOT NULL THEN {run('sum(z)')} / sqrt({run('count(z)')}) END"},
    R0, step("c0", {"z": f"CASE WHEN count(r) OVER {PAST} >= 20 THEN (r - avg(r) OVER {PAST}) / nullif(stddev_pop(r) OVER {PAST}, 0) END"}, "r0"), source="c0",
)
WA = [R0, "w0 AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, sum(r) OVER (PARTITION BY symbol) AS s, sum(r * r) OVER (PARTITION BY symbol) AS q, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM r0 WHERE r IS NOT NULL)",
      step("w1", {"a": run("sum(r)"), "b": run("sum(r * r)")}, "w0"), step("w2", {"m1": "a / k", "m2": "(s - a) / nullif(n - k, 0)"}, "w1"), step("w3", {"v1": "b / k - m1 * m1", "v2": "(q - b) / nullif(n - k, 0) - m2 * m2"}, "w2")]
add("q_2_8_63_wald", S.wald_breaks, {"wald": "CASE WHEN k >= floor(n * 0.15) AND k <= n - floor(n * 0.15) AND k > 1 THEN (m1 - m2) * (m1 - m2) / nullif(v1 / k + v2 / nullif(n - k, 0), 0) END"}, *WA, source="w3")
MR = [R0, step("g0", {"v": f"round({roll('stddev_samp(r)', 20)}, 12)", "ma": roll("avg(close)", 50), "dd": f"close / {run('max(close)')} - 1"}, "r0"),
      step("g1", {"p": "CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY symbol ORDER BY v NULLS LAST) + (count(v) OVER (PARTITION BY symbol, v) - 1) / 2) / count(v) OVER (PARTITION BY symbol) END"}, "g0"),
      step("g2", {"g": "CASE WHEN dd < -0.2 THEN 'crisis' WHEN p > 0.8 THEN 'high_volatility' WHEN p < 0.2 THEN 'low_volatility' WHEN close > ma THEN 'bull' WHEN close < ma THEN 'bear' ELSE 'neutral' END"}, "g1")]
table(
    "q_2_8_65_market_regime", lambda s, d: S.market_regime(bars(s, d)).select("symbol", seconds(), "market_regime"),
    over_bars("SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, g AS market_regime FROM g2", *MR),
)
table(
    "q_2_8_66_regime_periods", lambda s, d: S.periods(S.market_regime(bars(s, d)), "market_regime").select("symbol", "regime", seconds("start_ts"), seconds("end_ts"), "n_bars"),
    over_bars(
        "SELECT symbol, min(g) AS regime, CAST(epoch(min(ts)) AS BIGINT) AS start_ts, CAST(epoch(max(ts)) AS BIGINT) AS end_ts, count(*) AS n_bars FROM x1 GROUP BY symbol, rn", *MR,
        step("x0", {"nw": f"CASE WHEN g IS DISTINCT FROM {lag('g')} THEN 1 ELSE 0 END"}, "g2"), step("x1", {"rn": run("sum(nw)")}, "x0"),
    ),
)
add("q_2_8_67_drawdown", S.drawdown, {"peak": run("max(close)"), "drawdown": f"close / {run('max(close)')} - 1", "underwater": f"CASE WHEN close / {run('max(close)')} - 1 < 0 THEN 1.0 ELSE 0.0 END"})
DE = [step("d0", {"dd": f"close / {run('max(close)')} - 1", "nx": f"lead(ts) OVER ({W})"}), step("d1", {"nw": f"CASE WHEN (dd < 0) IS DISTINCT FROM ({lag('dd')} < 0) THEN 1 ELSE 0 END"}, "d0"), step("d2", {"rn": run("sum(nw)")}, "d1"),
      "ev AS (SELECT symbol, min(dd) AS depth, min(CASE WHEN dd < -0.02 THEN ts END) AS s, arg_min(ts, dd) AS t0, first(ts ORDER BY dd, ts) AS t, last(nx ORDER BY ts) AS e, count(*) AS n FROM d2 WHERE dd < 0 GROUP BY symbol, rn HAVING min(dd) < -0.02)"]
_E = lambda c: f"CAST(epoch({c}) AS BIGINT)"
table(
    "q_2_8_68_drawdown_events", lambda s, d: rounded(S.drawdown_events(bars(s, d)).select("symbol", "depth", seconds("start_ts"), seconds("trough_ts"), F.unix_timestamp("end_ts").cast("double").alias("end_ts"), "n_bars"), "depth", keys=("symbol", "start_ts", "trough_ts", "end_ts", "n_bars")),
    over_bars(f"SELECT symbol, round(depth, 6) AS depth, {_E('s')} AS start_ts, {_E('t')} AS trough_ts, CAST({_E('e')} AS DOUBLE) AS end_ts, n AS n_bars FROM ev", *DE),
)
table(
    "q_2_8_69_drawdown_statistics",
    lambda s, d: S.drawdown_events(bars(s, d)).groupBy("symbol").agg(F.round(F.min("depth"), 6).alias("max_depth"), F.round(F.avg("depth"), 6).alias("avg_depth"), F.max("n_bars").alias("longest"), F.round(F.avg("n_bars"), 6).alias("avg_bars"), F.count(F.lit(1)).alias("n_events")),
    over_bars("SELECT symbol, round(min(depth), 6) AS max_depth, round(avg(depth), 6) AS avg_depth, max(n) AS longest, round(avg(n), 6) AS avg_bars, count(*) AS n_events FROM ev GROUP BY symbol", *DE),
)
table(
    "q_2_8_70_worst_drawdowns", lambda s, d: S.drawdown_events(bars(s, d)).select(F.round("depth", 6).alias("depth"), "symbol", seconds("start_ts")).orderBy("depth", "symbol", "start_ts").limit(10),
    over_bars(f"SELECT round(depth, 6) AS depth, symbol, {_E('s')} AS start_ts FROM ev ORDER BY 1, 2, 3 LIMIT 10", *DE),
)
AHEAD = f"({W} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)"
add(
    "q_2_8_76_triple_barrier", S.triple_barrier,
    {"barrier_label": "CASE WHEN vol IS NOT NULL AND len(nx) = 10 THEN CASE WHEN len(hit) > 0 THEN hit[1] ELSE sign(nx[10] / close - 1) END END::DOUBLE"},
    R0, step("b0", {"vol": roll("stddev_samp(r)", 20), "nx": f"list(close) OVER {AHEAD}"}, "r0"),
    step("b1", {"hit": "list_filter(list_transform(nx, lambda x: CASE WHEN x / close - 1 >= 2 * vol THEN 1 WHEN x / close - 1 <= -2 * vol THEN -1 ELSE 0 END), lambda x: x <> 0)"}, "b0"), source="b1",
)
FR = "lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1"
add("q_2_8_78_forward_labels", S.forward_labels, {"forward_return": FR, "forward_up": "CASE WHEN f > 0 THEN 1.0 WHEN f IS NOT NULL THEN 0.0 END"}, step("f0", {"f": FR}), source="f0")
add(
    "q_2_8_77_meta_labels", S.meta_labels, {"meta_label": "m", "meta_accuracy": roll("avg(k)", 20)},
    step("f0", {"f": FR, "s": f"sign(close - {lag('close', 5)})"}), step("f1", {"m": "CASE WHEN s * f > 0 THEN 1.0 WHEN s IS NOT NULL AND f IS NOT NULL THEN 0.0 END"}, "f0"), step("f2", {"k": lag("m", 5)}, "f1"), source="f2",
)
table(
    "q_2_8_79_sequences",
    lambda s, d: rounded(S.sequences(bars(s, d)).withColumns({"window_sum": F.aggregate("window", F.lit(0.0), lambda a, x: a + x), "window_first": F.get("window", F.lit(0))}), "window_sum", "window_first", "target"),
    over_bars(
        "SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, round(list_sum(v), 6) AS window_sum, round(v[1], 6) AS window_first, round(t, 6) AS target FROM s0 WHERE len(v) = 60 AND rn % 10 = 0 AND t IS NOT NULL",
        step("s0", {"v": f"list(close) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)", "rn": f"row_number() OVER ({W})", "t": f"lead(close) OVER ({W}) / nullif(close, 0) - 1"}),
    ),
)

# Order flow and liquidity.
add("q_2_8_22_tick_rule", M.tick_rule, {"tick_sign": f"last_value(s IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}, step("s0", {"s": f"CAST(nullif(sign(close - {lag('close')}), 0) AS DOUBLE)"}), source="s0")
BV = step("v0", {"b": "volume * coalesce((close - low) / nullif(high - low, 0), 0)", "s": "volume * coalesce(1 - (close - low) / nullif(high - low, 0), 0)"})
add("q_2_8_23_bulk_volume", M.bulk_volume, {"buy_volume": "b", "sell_volume": "s"}, BV, source="v0")
OF = step("o0", {"o": "b - s", "br": "b / nullif(b + s, 0)"}, "v0")
add(
    "q_2_8_24_order_flow", M.flow_imbalance,
    {"ofi": "o", "ofi_z": f"(o - {roll('avg(o)', 20)}) / nullif({roll('stddev_samp(o)', 20)}, 0)", "ofi_minmax": f"(o - {roll('min(o)', 20)}) / nullif({roll('max(o)', 20)} - {roll('min(o)', 20)}, 0)", "ofi_cumulative": run("sum(o)"), "buy_ratio": "br"},
    BV, OF, source="o0",
)
add("q_2_8_25_volume_imbalance", M.flow_imbalance, {"volume_imbalance": roll("avg(br)", 20)}, BV, OF, source="o0")
VB = [
    "y0 AS (SELECT *, volume * coalesce((close - low) / nullif(high - low, 0), 0.5) AS b, volume * coalesce(1 - (close - low) / nullif(high - low, 0), 0.5) AS s, sum(volume) OVER (PARTITION BY symbol ORDER BY ts) AS hi FROM bars WHERE volume > 0)",
    "y1 AS (SELECT *, hi - volume AS lo, unnest(range(CAST(floor((hi - volume) / 500.0) AS BIGINT), CAST(ceil(hi / 500.0) AS BIGINT))) AS bucket FROM y0)",
    "y2 AS (SELECT symbol, bucket, sum(b * (least(hi, (bucket + 1) * 500.0) - greatest(lo, bucket * 500.0)) / volume) AS buy, sum(s * (least(hi, (bucket + 1) * 500.0) - greatest(lo, bucket * 500.0)) / volume) AS sell, sum(least(hi, (bucket + 1) * 500.0) - greatest(lo, bucket * 500.0)) AS filled FROM y1 GROUP BY 1, 2)",
]
table(
    "q_2_8_26_vpin_buckets", lambda s, d: rounded(M.vpin_buckets(bars(s, d), 500.0), "buy", "sell", "filled", keys=("symbol", "bucket"), digits=4),
    over_bars("SELECT symbol, bucket, round(buy, 4) AS buy, round(sell, 4) AS sell, round(filled, 4) AS filled FROM y2", *VB),
)
WB = "PARTITION BY symbol ORDER BY bucket"
table(
    "q_2_8_28_vpin", lambda s, d: rounded(M.vpin(bars(s, d)), "vpin", "toxic", keys=("symbol", "bucket")),
    over_bars(
        f"SELECT symbol, bucket, round(vpin, 6) AS vpin, CASE WHEN max(vpin) OVER ({WB} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) > 0.7 THEN 1.0 ELSE 0.0 END AS toxic FROM y3", *VB,
        f"y3 AS (SELECT symbol, bucket, {roll('sum(abs(buy - sell))', 50, w=WB)} / {roll('sum(buy + sell)', 50, w=WB)} AS vpin FROM y2 WHERE filled >= 500)",
    ),
)
SF = step("z0", {"sf": f"coalesce(2 * (close - low) / nullif(high - low, 0) - 1, 0) * volume / nullif({roll('avg(volume)', 20)}, 0)", "r": RET(1)})
add("q_2_8_32_signed_flow", M.signed_flow, {"signed_flow": "sf"}, SF, source="z0")
P60 = f"({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
add("q_2_8_31_kyle_rolling", M.kyle_rolling, {"kyle_lambda": f"CASE WHEN count(CASE WHEN r IS NOT NULL AND sf IS NOT NULL THEN 1 END) OVER {P60} = 60 THEN covar_pop(r, sf) OVER {P60} / nullif(var_pop(sf) OVER {P60}, 0) END"}, SF, source="z0")
table(
    "q_2_8_30_kyle_lambda", lambda s, d: rounded(M.kyle_full(bars(s, d)), "lam", "r2", "t_stat", "impact_bps", keys=("symbol", "n")),
    over_bars("SELECT symbol, n, round(lam, 6) AS lam, round(r2, 6) AS r2, round(sign(lam) * sqrt(r2 * (n - 2) / (1 - r2)), 6) AS t_stat, round(lam * sz * 10000, 6) AS impact_bps FROM (SELECT symbol, regr_slope(r, sf) AS lam, regr_r2(r, sf) AS r2, count(*) AS n, avg(abs(sf)) AS sz FROM z0 WHERE r IS NOT NULL AND sf IS NOT NULL GROUP BY symbol) WHERE n >= 30", SF),
)
RS = [step("q0", {"d": f"close - {lag('close')}"}), step("q1", {"p": lag("d")}, "q0"), step("q2", {"cv": f"CASE WHEN count(p) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN round(covar_samp(d, p) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 12) END"}, "q1"), step("q3", {"rs": "CASE WHEN cv < 0 THEN 2 * sqrt(-cv) WHEN cv >= 0 THEN 0.0 END"}, "q2")]
add("q_2_8_34_roll_spread", M.roll_spread, {"roll_spread": "rs", "roll_spread_pct": "rs / nullif(close, 0)"}, *RS, source="q3")
AM = [step("a0", {"a": f"abs({RET(1)}) / nullif(close * volume, 0) * 1e6"}), step("a1", {"am": roll("avg(a)", 20, 5)}, "a0")]
add("q_2_8_35_amihud", M.amihud, {"amihud": "am", "amihud_log": "CASE WHEN am > 0 THEN ln(am) END", "amihud_relative": f"am / nullif({roll('avg(am)', 100, 20)}, 0)"}, *AM, source="a1")
ZE = lambda x: f"coalesce(({x} - {roll(f'avg({x})', 60)}) / ({roll(f'stddev_samp({x})', 60)} + 1e-9), 0)"
add(
    "q_2_8_36_liquidity_score", M.liquidity_score, {"liquidity_score": f"({ZE('sp')} + {ZE('al')}) / 2"}, *RS,
    step("q4", {"a": f"abs({RET(1)}) / nullif(close * volume, 0) * 1e6", "sp": "round(rs / nullif(close, 0), 12)"}, "q3"), step("q5", {"am": roll("avg(a)", 20, 5)}, "q4"), step("q6", {"al": "CASE WHEN am > 0 THEN round(ln(am), 12) END"}, "q5"), source="q6",
)
F50 = f"({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
add(
    "q_2_8_44_smart_money", M.smart_money,
    {"block": "b", "block_ratio": "br", "impact_ratio": "ir", "smart_money_index": "coalesce((sb - ss) / nullif(sb + ss, 0), 0)", "institutional_activity": "CASE WHEN ir IS NULL OR br IS NULL THEN 0.0 ELSE br * 0.5 + least(greatest(ir, 0), 2) / 4 END"},
    step("j0", {"q": f"CASE WHEN count(volume) OVER {F50} = 50 THEN quantile_cont(volume, 0.95) OVER {F50} END", "r": f"abs({RET(1)})", "sd": "coalesce((close - low) / nullif(high - low, 0), 0.5) - 0.5"}),
    step("j1", {"b": "CASE WHEN volume > q THEN 1.0 ELSE 0.0 END::DOUBLE"}, "j0"), step("j2", {"vb": "CASE WHEN sd > 0 THEN b * volume ELSE 0 END", "vs": "CASE WHEN sd < 0 THEN b * volume ELSE 0 END", "rb": "r * b", "rn": "r * (1 - b)"}, "j1"),
    step("j3", {"br": roll("avg(b)", 50), "ir": f"{roll('avg(rb)', 50)} / nullif({roll('avg(rn)', 50)}, 0)", "sb": roll("sum(vb)", 50), "ss": roll("sum(vs)", 50)}, "j2"), source="j3",
)
table(
    "q_2_8_27_bucket_size", lambda s, d: rounded(M.daily_bucket_size(bars(s, d)), "p01", "adv_share", keys=("symbol",)),
    over_bars("SELECT symbol, round(quantile_cont(v, 0.01), 6) AS p01, round(avg(v) / 100, 6) AS adv_share FROM (SELECT symbol, CAST(ts AS DATE) AS d, sum(volume) AS v FROM bars GROUP BY 1, 2) GROUP BY symbol"),
)
WP = "PARTITION BY a, b ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW"
PC = [R0, "pc AS (SELECT x.symbol AS a, y.symbol AS b, x.ts, x.r AS ra, y.r AS rb FROM r0 x JOIN r0 y ON x.ts = y.ts AND x.symbol < y.symbol WHERE x.r IS NOT NULL AND y.r IS NOT NULL)",
      f"pd AS (SELECT a, b, ts, CASE WHEN count(*) OVER ({WP}) = 60 THEN covar_pop(ra, rb) OVER ({WP}) / nullif(stddev_pop(ra) OVER ({WP}) * stddev_pop(rb) OVER ({WP}), 0) END AS c FROM pc)"]
table("q_2_8_7_pair_correlation", lambda s, d: rounded(M.pair_correlations(bars(s, d)), "corr", keys=("a", "b", "ts")), over_bars("SELECT a, b, CAST(epoch(ts) AS BIGINT) AS ts, round(c, 6) AS corr FROM pd WHERE c IS NOT NULL", *PC))
CR = [*PC[:2], PC[2].replace("= 60 THEN", ">= 30 THEN"), "ce AS (SELECT ts, avg(c) AS ac, stddev_pop(c) AS di, count(*) AS n FROM pd WHERE c IS NOT NULL GROUP BY ts)"]
table("q_2_8_55_average_correlation", lambda s, d: rounded(M.correlation_regime(bars(s, d)), "avg_corr", "dispersion", keys=("ts", "n_pairs")), over_bars("SELECT CAST(epoch(ts) AS BIGINT) AS ts, n AS n_pairs, round(ac, 6) AS avg_corr, round(di, 6) AS dispersion FROM ce", *CR))
table(
    "q_2_8_58_correlation_labels", lambda s, d: M.correlation_regime(bars(s, d)).select(seconds(), "label"),
    over_bars("SELECT CAST(epoch(ts) AS BIGINT) AS ts, CASE WHEN round(ac, 9) < 0.2 THEN 'low' WHEN round(ac, 9) < 0.4 THEN 'normal' WHEN round(ac, 9) < 0.6 THEN 'high' ELSE 'crisis' END AS label FROM ce", *CR),
)
LX = ["l0 AS (SELECT symbol, ts, ln(close) AS x, lag(ln(close)) OVER (PARTITION BY symbol ORDER BY ts) AS p, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars)"]
table(
    "q_2_8_20_ou_parameters", lambda s, d: rounded(M.ou_parameters(bars(s, d)), "theta", "mu", "sigma", "half_life", keys=("symbol",), digits=5),
    over_bars(
        f"SELECT symbol, CASE WHEN f THEN round(-ln(b), 5) END AS theta, CASE WHEN f THEN round(a / (1 - b), 5) END AS mu, CASE WHEN f THEN round(sqrt((syy - b * sxy) / (n - 2)), 5) END AS sigma, CASE WHEN f THEN round({-math.log(2)!r} / ln(b), 5) END AS half_life FROM (SELECT *, b > 0 AND b < 1 AS f FROM (SELECT symbol, regr_slope(x, p) AS b, regr_intercept(x, p) AS a, regr_syy(x, p) AS syy, regr_sxy(x, p) AS sxy, count(*) AS n FROM l0 WHERE p IS NOT NULL GROUP BY symbol))",
        *LX,
    ),
)
PS = ["s0 AS (SELECT x.symbol AS a, y.symbol AS b, x.ts, x.close AS y, y.close AS x FROM bars x JOIN bars y ON x.ts = y.ts AND x.symbol < y.symbol)",
      "s1 AS (SELECT *, regr_slope(y, x) OVER (PARTITION BY a, b) AS h FROM s0)", "s2 AS (SELECT *, y - h * x AS sp FROM s1)"]
WS = "PARTITION BY a, b ORDER BY ts"
table(
    "q_2_8_18_pair_spread", lambda s, d: rounded(M.pair_spreads(bars(s, d)), "hedge", "spread", "z", keys=("a", "b", "ts"), digits=5),
    over_bars(f"SELECT a, b, CAST(epoch(ts) AS BIGINT) AS ts, round(h, 5) AS hedge, round(sp, 5) AS spread, round((sp - {roll('avg(sp)', 20, w=WS)}) / ({roll('stddev_samp(sp)', 20, w=WS)} + 1e-8), 5) AS z FROM s2", *PS),
)
