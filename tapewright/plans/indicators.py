"""Queries of trend, momentum, volatility and volume indicators (survey 2.5 to 2.7) and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tapewright.operators import momentum, trend, volatility
from tapewright.plans.build import on_bars
from tapewright.plans.oracle import TR, ema, lag, over_bars, roll, rollup, run, wide
from tapewright.sources.tables import bars, rollup as rollup_bars, seconds, ticks


YEAR = math.sqrt(252 * 26)
QUERIES: dict = {}
ORACLES: dict = {}


def add(name, operator, columns, *steps, source="bars"):
    QUERIES[name] = on_bars(operator, *columns)
    ORACLES[name] = wide(columns, source, *steps)


def step(name, columns, source="bars"):
    """A CTE that adds columns."""
    return f"{name} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source})"


def weighted(weights):
    n = len(weights)
    return " + ".join(f"{w!r} * {'close' if k == n - 1 else lag('close', n - 1 - k)}" for k, w in enumerate(weights))


add("q_2_5_1_sma", trend.sma, {"sma_20": roll("avg(close)", 20)})
add("q_2_5_2_ema", trend.ema_of, {"ema_12": ema("close", 12)})
ADJ = "list_reduce(list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda y, v: {r!r} * y + v)"
add(
    "q_2_5_3_ema_adjusted", lambda b: trend.ema_of(b, 12, adjust=True),
    {"ema_12": f"{ADJ.format(r=1 - 2 / 13)} / ((1 - pow({1 - 2 / 13!r}, row_number() OVER (PARTITION BY symbol ORDER BY ts))) / {2 / 13!r})"},
)
add("q_2_5_4_wma", trend.wma, {"wma_20": weighted([(k + 1) / 210 for k in range(20)])})
E1, E2, E3 = step("e1", {"a1": ema("close", 20)}), step("e2", {"a2": ema("a1", 20)}, "e1"), step("e3", {"a3": ema("a2", 20)}, "e2")
add("q_2_5_5_dema", trend.multi_ema, {"dema_20": "2 * a1 - a2"}, E1, E2, source="e2")
add("q_2_5_6_tema", trend.multi_ema, {"tema_20": "3 * a1 - 3 * a2 + a3"}, E1, E2, E3, source="e3")
add(
    "q_2_5_7_macd", trend.macd, {"macd": "macd", "macd_signal": "s", "macd_hist": "macd - s"},
    step("m0", {"f": ema("close", 12), "g": ema("close", 26)}), step("m1", {"macd": "f - g"}, "m0"), step("m2", {"s": ema("macd", 9)}, "m1"), source="m2",
)
add(
    "q_2_5_8_adx", trend.adx, {"adx_14": "adx", "plus_di_14": "p", "minus_di_14": "m"},
    step("d0", {"tr": TR, "up": f"high - {lag('high')}", "dn": f"{lag('low')} - low"}),
    step("d1", {"dp": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END", "dm": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END"}, "d0"),
    step("d2", {"tra": ema("tr", 14), "ep": ema("dp", 14), "em": ema("dm", 14)}, "d1"),
    step("d3", {"p": "100 * ep / nullif(tra, 0)", "m": "100 * em / nullif(tra, 0)"}, "d2"),
    step("d4", {"dx": "coalesce(100 * abs(p - m) / nullif(p + m, 0), 0.0)"}, "d3"), step("d5", {"adx": ema("dx", 14)}, "d4"), source="d5",
)
MID = lambda n: f"({roll('max(high)', n)} + {roll('min(low)', n)}) / 2"
add(
    "q_2_5_10_ichimoku", trend.ichimoku, {"tenkan": "t", "kijun": "k", "span_a": lag("a", 26), "span_b": lag("b", 26)},
    step("i0", {"t": MID(9), "k": MID(26), "b": MID(52)}), step("i1", {"a": "(t + k) / 2"}, "i0"), source="i1",
)
_raw = [math.exp(-((k - 0.85 * 19) ** 2) / (2 * (20 / 6) ** 2)) for k in range(20)]
add("q_2_5_14_alma", trend.alma, {"alma_20": weighted([w / sum(_raw) for w in _raw])})
add(
    "q_2_5_16_adaptive_atr", trend.adaptive_atr, {"adaptive_atr": "er * f + (1 - er) * s"},
    step("a0", {"tr": TR, "d": f"abs(close - {lag('close')})"}),
    step("a1", {"er": f"coalesce(abs(close - {lag('close', 14)}) / nullif({roll('sum(d)', 14)}, 0), 0.0)", "f": ema("tr", 5), "s": ema("tr", 50)}, "a0"), source="a1",
)
PERIODS = (5, 10, 20, 50, 100, 200)
add(
    "q_2_5_17_technical", trend.technical,
    {f"close_to_sma_{n}": f"close / nullif(s{n}, 0) - 1" for n in PERIODS} | {f"sma_cross_{a}_{b}": f"CASE WHEN s{a} > s{b} THEN 1.0 ELSE 0.0 END" for a, b in zip(PERIODS, PERIODS[1:])},
    step("s", {f"s{n}": roll("avg(close)", n) for n in PERIODS}), source="s",
)


def _timeframes(spark, sf_dir):
    trades = ticks(spark, sf_dir)
    higher = {e: rollup_bars(trades, e) for e in ("1 hour", "4 hours")}
    df = trend.multi_timeframe(rollup_bars(trades, "15 minutes"), higher)
    return df.select("symbol", seconds(), *[F.col(c).cast("double").alias(c) for c in ("trend_1_hour", "trend_4_hours", "trend_votes", "trend_unanimous")])


QUERIES["q_2_5_18_timeframe_trend"] = _timeframes
_T = lambda t, e: f"{t} AS (SELECT symbol, ts + INTERVAL {e} AS ts, CASE WHEN close > {roll('avg(close)', 10)} THEN 1 WHEN {roll('avg(close)', 10)} IS NOT NULL THEN 0 END AS t FROM b{t})"
ORACLES["q_2_5_18_timeframe_trend"] = over_bars(
    """SELECT b.symbol, CAST(epoch(b.ts) AS BIGINT) AS ts, CAST(h.t AS DOUBLE) AS trend_1_hour, CAST(g.t AS DOUBLE) AS trend_4_hours,
    CAST(coalesce(h.t, 0) + coalesce(g.t, 0) AS DOUBLE) AS trend_votes, CAST(CASE WHEN h.t = g.t THEN 1 ELSE 0 END AS DOUBLE) AS trend_unanimous
    FROM bars b ASOF LEFT JOIN h1 h ON b.symbol = h.symbol AND b.ts >= h.ts ASOF LEFT JOIN h4 g ON b.symbol = g.symbol AND b.ts >= g.ts""",
    rollup("bh1", "1 HOUR"), rollup("bh4", "4 HOUR"), _T("h1", "1 HOUR"), _T("h4", "4 HOUR"),
)

# Momentum.
G0 = step("g0", {"d": f"coalesce(close - {lag('close')}, 0)"})
G1 = step("g1", {"g": "greatest(d, 0)", "l": "greatest(-d, 0)"}, "g0")
RSI = "CASE WHEN al = 0 AND ag > 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END"
add("q_2_6_1_rsi", momentum.rsi, {"rsi_14": RSI}, G0, G1, step("g2", {"ag": ema("g", 14), "al": ema("l", 14)}, "g1"), source="g2")
_r14 = 1 - 2 / 15
_LIST = "list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_NUM = lambda x: f"CASE WHEN {x} IS NOT NULL THEN list_reduce({_LIST.format(x=x)}, lambda y, v: {_r14!r} * y + v) / ((1 - pow({_r14!r}, len({_LIST.format(x=x)}))) / {2 / 15!r}) END"
add(
    "q_2_6_2_rsi_adjusted", lambda b: momentum.rsi(b, method="adjusted"), {"rsi_14": "100 - 100 / (1 + ag / CASE WHEN al = 0 THEN 1e-10 ELSE al END)"},
    step("g0", {"d": f"close - {lag('close')}"}), step("g1", {"g": "CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0.0 END", "l": "CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0.0 END"}, "g0"),
    step("g2", {"ag": _NUM("g"), "al": _NUM("l")}, "g1"), source="g2",
)
add(
    "q_2_6_3_rsi_mean", lambda b: momentum.rsi(b, method="mean"), {"rsi_14": RSI},
    step("g0", {"d": f"close - {lag('close')}"}), step("g1", {"g": "CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0.0 END", "l": "CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0.0 END"}, "g0"),
    step("g2", {"ag": f"round({roll('avg(g)', 14)}, 10)", "al": f"round({roll('avg(l)', 14)}, 10)"}, "g1"), source="g2",
)
add(
    "q_2_6_4_stochastic", momentum.stochastic, {"stoch_k": "sk", "stoch_d": roll("avg(sk)", 3)},
    step("k0", {"k": f"100 * (close - {roll('min(low)', 14)}) / nullif({roll('max(high)', 14)} - {roll('min(low)', 14)}, 0)"}), step("k1", {"sk": roll("avg(k)", 3)}, "k0"), source="k1",
)
add("q_2_6_5_williams", momentum.williams, {"williams_r_14": f"-100 * ({roll('max(high)', 14)} - close) / nullif({roll('max(high)', 14)} - {roll('min(low)', 14)}, 0)"})
add(
    "q_2_6_6_cci", momentum.cci, {"cci_20": "CASE WHEN ma IS NOT NULL THEN (tp - ma) / nullif(0.015 * list_sum(list_transform(v, lambda x: abs(x - ma))) / 20, 0) END"},
    step("c0", {"tp": "(high + low + close) / 3"}), step("c1", {"ma": roll("avg(tp)", 20), "v": "list(tp) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"}, "c0"), source="c1",
)
add("q_2_6_7_roc", momentum.roc, {"roc_10": f"100 * (close / nullif({lag('close', 10)}, 0) - 1)"})
add("q_2_6_8_momentum", momentum.roc, {"momentum_10": f"close - {lag('close', 10)}"})
add(
    "q_2_6_9_tsi", momentum.tsi, {"tsi": "100 * d2 / nullif(a2, 0)"},
    step("t0", {"d": f"close - {lag('close')}"}), step("t1", {"d1": ema("d", 25), "a1": ema("abs(d)", 25)}, "t0"), step("t2", {"d2": ema("d1", 13), "a2": ema("a1", 13)}, "t1"), source="t2",
)
_UO = lambda n: f"{roll('sum(bp)', n)} / nullif({roll('sum(tr)', n)}, 0)"
add(
    "q_2_6_10_ultimate", momentum.ultimate, {"ultimate": f"100 * (4 * ({_UO(7)}) + 2 * ({_UO(14)}) + ({_UO(28)})) / 7"},
    step("u0", {"pc": lag("close")}), step("u1", {"bp": "close - least(low, pc)", "tr": "greatest(high, pc) - least(low, pc)"}, "u0"), source="u1",
)
RET = lambda k: f"close / nullif({lag('close', k)}, 0) - 1"
add("q_2_6_11_returns", momentum.returns, {f"return_{k}": RET(k) for k in (1, 5, 10, 20, 60)})
add("q_2_6_12_returns_by_symbol", lambda b: momentum.returns(b, (1,)), {"return_1": RET(1)})
add("q_2_6_13_log_returns", lambda b: momentum.returns(b, (1, 5), log=True), {f"log_return_{k}": f"ln(close) - ln({lag('close', k)})" for k in (1, 5)})
add("q_2_6_14_lags", momentum.lags, {f"close_lag_{k}": lag("close", k) for k in (1, 2, 5, 10)})
add("q_2_6_15_changes", momentum.lags, {f"close_change_{k}": f"close - {lag('close', k)}" for k in (1, 2, 5, 10)})

# Volatility and bands.
BB = step("b0", {"m": roll("avg(close)", 20), "sd": roll("stddev_samp(close)", 20)})
add("q_2_7_1_bollinger", volatility.bollinger, {"bb_middle": "m", "bb_upper": "m + 2 * sd", "bb_lower": "m - 2 * sd", "bb_width": "100 * 4 * sd / nullif(m, 0)", "bb_pct": "(close - m + 2 * sd) / nullif(4 * sd, 0)"}, BB, source="b0")
add("q_2_7_2_bollinger_eps", lambda b: volatility.bollinger(b, eps=1e-10), {"bb_width": "100 * 4 * sd / (m + 1e-10)", "bb_pct": "(close - m + 2 * sd) / (4 * sd + 1e-10)"}, BB, source="b0")
TR0 = step("t0", {"tr": TR})
add("q_2_7_3_atr", volatility.atr, {"atr_14": ema("tr", 14)}, TR0, source="t0")
add("q_2_7_4_atr_adjusted", lambda b: volatility.atr(b, adjust=True), {"atr_14": _NUM("tr")}, TR0, source="t0")
add(
    "q_2_7_5_keltner", volatility.keltner, {"kc_middle": "k", "kc_upper": "k + 2 * a", "kc_lower": "k - 2 * a"},
    TR0, step("t1", {"k": ema("close", 20), "a": ema("tr", 20)}, "t0"), source="t1",
)
add("q_2_7_6_donchian", volatility.donchian, {"dc_upper": roll("max(high)", 20), "dc_lower": roll("min(low)", 20), "dc_middle": MID(20)})
LR = step("r0", {"r": f"ln(close) - ln({lag('close')})"})
add("q_2_7_7_historical_volatility", volatility.historical, {"hist_vol_20": f"{roll('stddev_samp(r)', 20)} * {YEAR!r}"}, LR, source="r0")
RB = step(
    "v0",
    {"gk": f"0.5 * pow(ln(high / low), 2) - {2 * math.log(2) - 1!r} * pow(ln(close / open), 2)", "pk": f"pow(ln(high / low), 2) / {4 * math.log(2)!r}", "onr": f"ln(open) - ln({lag('close')})",
     "oc": "ln(close / open)", "rs": "ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open))"},
)
_K = 0.34 / (1.34 + 21 / 19)
ROOT = lambda x: f"CASE WHEN {x} >= 0 THEN sqrt({x}) END * {YEAR!r}"
RB1 = step("v1", {"g": roll("avg(gk)", 20), "p": roll("avg(pk)", 20), "y": f"{roll('var_samp(onr)', 20)} + {_K!r} * {roll('var_samp(oc)', 20)} + {1 - _K!r} * {roll('avg(rs)', 20)}"}, "v0")
add("q_2_7_8_garman_klass", volatility.range_based, {"garman_klass_20": ROOT("g")}, RB, RB1, source="v1")
add("q_2_7_9_parkinson", volatility.range_based, {"parkinson_20": ROOT("p")}, RB, RB1, source="v1")
add("q_2_7_10_yang_zhang", volatility.range_based, {"yang_zhang_20": ROOT("y")}, RB, RB1, source="v1")
SR = step("r0", {"r": RET(1)})
add("q_2_7_11_realised_volatility", volatility.realised, {f"volatility_{n}": roll("stddev_samp(r)", n) for n in (10, 20, 50)}, SR, source="r0")
add("q_2_7_12_rolling_volatility", lambda b: volatility.realised(b, (20,)), {"volatility_20": roll("stddev_samp(r)", 20)}, SR, source="r0")
add("q_2_7_13_obv", volatility.obv, {"obv": f"CASE WHEN s IS NOT NULL THEN {run('sum(s)')} END"}, step("o0", {"s": f"sign(close - {lag('close')}) * volume"}), source="o0")
TP = step("p0", {"tp": "(high + low + close) / 3"})
add("q_2_7_14_vwap_running", volatility.cumulative_vwap, {"vwap_running": f"{run('sum(tp * volume)')} / nullif({run('sum(volume)')}, 0)"}, TP, source="p0")
add(
    "q_2_7_15_mfi", volatility.mfi, {"mfi_14": f"100 * {roll('sum(u)', 14)} / nullif({roll('sum(u)', 14)} + {roll('sum(d)', 14)}, 0)"},
    TP, step("p1", {"ptp": lag("tp")}, "p0"), step("p2", {"u": "CASE WHEN tp > ptp THEN tp * volume ELSE 0.0 END", "d": "CASE WHEN tp < ptp THEN tp * volume ELSE 0.0 END"}, "p1"), source="p2",
)
MFV = step("f0", {"mfv": "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0.0) * volume"})
add("q_2_7_16_accumulation", volatility.flow, {"ad_line": run("sum(mfv)")}, MFV, source="f0")
add("q_2_7_17_chaikin", volatility.flow, {"cmf_20": f"{roll('sum(mfv)', 20)} / nullif({roll('sum(volume)', 20)}, 0)"}, MFV, source="f0")
add("q_2_7_18_volume_roc", volatility.volume_change, {"volume_roc_10": f"100 * (CAST(volume AS DOUBLE) / nullif({lag('volume', 10)}, 0) - 1)"})
add("q_2_7_19_force_index", volatility.force_index, {"force_index_13": ema("f", 13)}, step("f0", {"f": f"(close - {lag('close')}) * volume"}), source="f0")
add(
    "q_2_7_20_ease_of_movement", volatility.ease_of_movement, {"eom_14": roll("avg(e)", 14)},
    step("m0", {"mid": "(high + low) / 2"}), step("m1", {"e": f"CASE WHEN high = low AND volume > 0 THEN (mid - {lag('mid')}) * 0 ELSE (mid - {lag('mid')}) / nullif(volume / nullif(high - low, 0), 0) END"}, "m0"), source="m1",
)
add("q_2_7_21_volume_features", volatility.volume_features, {"volume_ma": roll("avg(volume)", 20), "volume_ratio": f"volume / ({roll('avg(volume)', 20)} + 1)"})
add("q_2_7_23_volume_confirmation", volatility.volume_features, {"volume_confirmed": f"CASE WHEN volume > 1.5 * {roll('avg(volume)', 20)} THEN 1.0 ELSE 0.0 END"})
