"""Queries of single checks on spoilt bars (survey 2.2) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.operators import checks as C
from tapewright.plans.build import rounded
from tapewright.plans.indicators import RET, step
from tapewright.plans.oracle import lag, over_bars
from tapewright.sources.tables import bars, ticks

QUERIES: dict = {}
ORACLES: dict = {}
E = lambda c="ts": f"CAST(epoch({c}) AS BIGINT)"


def _spoilt(s, d):
    """Bars with missing closes, negative lows, highs under the low, and empty volumes."""
    v = F.col("volume")
    return bars(s, d).withColumns({
        "close": F.when(v % 7 == 0, None).otherwise(F.col("close")), "high": F.when(v % 13 == 0, F.col("low") - 1).otherwise(F.col("high")),
        "low": F.when(v % 11 == 0, -F.col("low")).otherwise(F.col("low")), "volume": F.when(v % 5 == 0, 0).otherwise(v),
    })


SPOILT = """sb AS (SELECT symbol, ts, open, CASE WHEN volume % 13 = 0 THEN low - 1 ELSE high END AS high, CASE WHEN volume % 11 = 0 THEN -low ELSE low END AS low,
 CASE WHEN volume % 7 = 0 THEN NULL ELSE close END AS close, CASE WHEN volume % 5 = 0 THEN 0 ELSE volume END AS volume FROM bars)"""


def add(name, make, select, *steps):
    QUERIES[name] = make
    ORACLES[name] = over_bars(select, SPOILT, *steps)


def n_if(c):
    return f"count(*) FILTER ({c})"


add("q_2_2_1_missing", lambda s, d: rounded(C.missing(_spoilt(s, d)), "missing_pct", keys=("symbol", "field", "severity")), " UNION ALL ".join(f"SELECT symbol, '{c}' AS field, CASE WHEN m > 5 THEN 'error' WHEN m > 0 THEN 'warning' ELSE 'ok' END AS severity, round(m, 6) AS missing_pct FROM (SELECT symbol, 100 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS m FROM sb GROUP BY symbol)" for c in C.OHLC))
add("q_2_2_2_relations", lambda s, d: C.relations(_spoilt(s, d)), f"SELECT symbol, {n_if('high < open OR high < close OR high < low')} AS high_wrong, {n_if('low > open OR low > close OR low > high')} AS low_wrong FROM sb GROUP BY symbol")
add("q_2_2_3_prices", lambda s, d: C.prices(_spoilt(s, d)), "SELECT symbol, " + ", ".join(" + ".join(n_if(f.format(c)) for c in C.OHLC) + f" AS {n}" for n, f in {"negative": "{0} < 0", "tiny": "{0} >= 0 AND {0} < 0.01", "infinite": "isinf({0})"}.items()) + " FROM sb GROUP BY symbol")
add("q_2_2_5_volumes", lambda s, d: rounded(C.volumes(_spoilt(s, d), 2.0), "zero_pct", keys=("symbol", "negative", "outliers")), f"SELECT symbol, {n_if('volume < 0')} AS negative, {n_if('volume > c')} AS outliers, round(100 * avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0 END), 6) AS zero_pct FROM (SELECT *, avg(volume) OVER (PARTITION BY symbol) + 2 * stddev_samp(volume) OVER (PARTITION BY symbol) AS c FROM sb) GROUP BY symbol")
add("q_2_2_6_time_gaps", lambda s, d: rounded(C.time_gaps(bars(s, d)), "gap"), f"SELECT symbol, {E()} AS ts, round(gap, 6) AS gap FROM gp WHERE gap > 60 AND gap < 900", step("gp", {"gap": f"({E()} - {E(lag('ts'))}) / 60"}))
add("q_2_2_7_duplicates", lambda s, d: C.duplicates(ticks(s, d).withColumn("ts", F.date_trunc("minute", "ts")), "ts"), "SELECT symbol, count(*) - count(DISTINCT date_trunc('minute', ts)) AS duplicates FROM ticks GROUP BY symbol")
add("q_2_2_8_summary", lambda s, d: rounded(C.summary(_spoilt(s, d)).withColumn("last_ts", F.unix_timestamp("last")), "lowest", "highest", "mean_close", keys=("symbol", "ts", "last_ts", "n", "nulls", "volume")), f"SELECT symbol, {E('min(ts)')} AS ts, {E('max(ts)')} AS last_ts, count(*) AS n, {n_if('close IS NULL')} AS nulls, CAST(sum(volume) AS BIGINT) AS volume, round(min(low), 6) AS lowest, round(max(high), 6) AS highest, round(avg(close), 6) AS mean_close FROM sb GROUP BY symbol")
add(
    "q_2_2_12_backtest_input", lambda s, d: rounded(C.backtest_input(_spoilt(s, d)), "broken_pct", keys=("symbol", "splits", "dividends", "weekend", "verdict")),
    "SELECT symbol, splits, dividends, weekend, round(bp, 6) AS broken_pct, CASE WHEN bp > 1 THEN 'reject' WHEN dividends > 12 OR splits > 0 THEN 'warning' ELSE 'ok' END AS verdict FROM bi",
    step("bj", {"r": f"close / nullif({lag('close')}, 0) - 1", "v": f"volume / nullif({lag('volume')}, 0) - 1"}, "sb"),
    f"bi AS (SELECT symbol, {n_if('abs(r) > 0.2 AND abs(v) > 1')} AS splits, {n_if('r > -0.1 AND r < -0.01 AND abs(v) <= 1')} AS dividends, {n_if('dayofweek(ts) IN (0, 6)')} AS weekend, 100 * avg(CASE WHEN high < greatest(open, close, low) OR low > least(open, close, high) THEN 1.0 ELSE 0 END) AS bp FROM bj GROUP BY symbol)",
)
add(
    "q_2_2_14_alignment", lambda s, d: rounded(C.alignment(bars(s, d), "click"), "start_days", "end_days", "count_pct", "missing_pct", keys=("symbol", "severity")),
    "SELECT symbol, CASE WHEN sd > 1 OR ed > 1 THEN 'error' WHEN cp > 10 OR mp > 10 THEN 'warning' ELSE 'ok' END AS severity, round(sd, 6) AS start_days, round(ed, 6) AS end_days, round(cp, 6) AS count_pct, round(mp, 6) AS missing_pct FROM ac",
    "rf AS (SELECT * FROM bars WHERE symbol = 'click')", f"r1 AS (SELECT {E('min(ts)')} AS ra, {E('max(ts)')} AS rb, count(*) AS rn FROM rf)",
    f"ac AS (SELECT symbol, abs({E('min(ts)')} - any_value(ra)) / 86400 AS sd, abs({E('max(ts)')} - any_value(rb)) / 86400 AS ed, 100 * abs(count(*) - any_value(rn)) / any_value(rn) AS cp, 100 * (1 - {n_if('ts IN (SELECT ts FROM rf)')} / any_value(rn)) AS mp FROM bars, r1 GROUP BY symbol)",
)
GAPS = [step("gp", {"gap": f"{E()} - {E(lag('ts'))}"}, "sb"), "gm AS (SELECT symbol AS s0, quantile_cont(gap, 0.5) AS mg FROM gp GROUP BY 1)", "lg AS (SELECT * FROM gp JOIN gm ON symbol = s0 WHERE gap > 10 * mg)"]
add(
    "q_2_2_15_quick", lambda s, d: rounded(C.quick(_spoilt(s, d)), "missing_pct", "zero_pct", keys=("symbol", "n", "negative", "gaps", "valid")),
    "SELECT symbol, n, negative, coalesce((SELECT count(*) FROM lg WHERE lg.symbol = qk.symbol), 0) AS gaps, CAST(n >= 50 AND negative = 0 AND mp <= 5 AND zp <= 10 AS BIGINT) AS valid, round(mp, 6) AS missing_pct, round(zp, 6) AS zero_pct FROM qk",
    *GAPS, f"qk AS (SELECT symbol, count(*) AS n, {n_if('least(open, high, low, close) < 0')} AS negative, 100 * avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0 END) AS mp, 100 * avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0 END) AS zp FROM sb GROUP BY symbol)",
)
add("q_2_2_17_long_gaps", lambda s, d: rounded(C.long_gaps(bars(s, d)), "gap", "median_gap"), f"SELECT symbol, {E()} AS ts, round(gap, 6) AS gap, round(mg, 6) AS median_gap FROM lg", *GAPS)
add("q_2_2_16_sigma_jumps", lambda s, d: rounded(C.sigma_jumps(bars(s, d), 4.0), "r"), f"SELECT symbol, {E()} AS ts, round(r, 6) AS r FROM (SELECT *, avg(r) OVER (PARTITION BY symbol) AS m, stddev_samp(r) OVER (PARTITION BY symbol) AS sd FROM sj) WHERE abs(r - m) > 4 * sd", step("sj", {"r": RET(1)}))
add("q_2_2_19_possible_splits", lambda s, d: rounded(C.possible_splits(bars(s, d)), "r", keys=("symbol", "ts", "k")), f"SELECT symbol, {E()} AS ts, k, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM ps WHERE r < -0.4 OR r > 0.8) WHERE k <= 5", step("ps", {"r": RET(1)}))
add("q_2_2_31_safe_divide", lambda s, d: rounded(_spoilt(s, d).withColumn("x", C.safe_divide(F.col("close"), F.col("volume"), -1.0)), "x"), f"SELECT symbol, {E()} AS ts, round(CASE WHEN close IS NULL OR volume = 0 THEN -1 ELSE close / volume END, 6) AS x FROM sb")
add("q_2_2_32_clip_outliers", lambda s, d: rounded(C.clipped(_spoilt(s, d), "volume", 1.5), "clipped", "nulled", "outlier"), f"SELECT symbol, {E()} AS ts, round(greatest(a, least(b, volume)), 6) AS clipped, CASE WHEN volume < a OR volume > b THEN NULL ELSE CAST(volume AS DOUBLE) END AS nulled, CASE WHEN volume < a OR volume > b THEN 1.0 ELSE 0.0 END AS outlier FROM (SELECT *, avg(volume) OVER w - 1.5 * stddev_samp(volume) OVER w AS a, avg(volume) OVER w + 1.5 * stddev_samp(volume) OVER w AS b FROM sb WINDOW w AS (PARTITION BY symbol))")
add("q_2_2_47_matrix_checks", lambda s, d: C.matrix(_spoilt(s, d).withColumn("flat", F.lit(1.0)), ["open", "close", "flat"]), " UNION ALL ".join(f"SELECT '{c}' AS feature, {n_if(x + ' IS NULL')} AS nulls, {n_if(f'isnan({x})')} AS nans, {n_if(f'isinf({x})')} AS infinite, CAST(min({x}) IS NOT DISTINCT FROM max({x}) AS BIGINT) AS constant FROM sb" for c, x in {"open": "open", "close": "close", "flat": "1.0::DOUBLE"}.items()))

# Derived columns and scans of bars.
add("q_2_11_3_bar_fields", lambda s, d: rounded(bars(s, d).withColumns({"typical": (F.col("high") + F.col("low") + F.col("close")) / 3, "span": F.col("high") - F.col("low"), "body": F.abs(F.col("close") - F.col("open")), "bullish": (F.col("close") > F.col("open")).cast("double")}), "typical", "span", "body", "bullish"), f"SELECT symbol, {E()} AS ts, round((high + low + close) / 3, 6) AS typical, round(high - low, 6) AS span, round(abs(close - open), 6) AS body, CASE WHEN close > open THEN 1.0 ELSE 0.0 END AS bullish FROM bars")
add("q_2_1_26_many_symbols", lambda s, d: rounded(bars(s, d).where("symbol in ('click', 'view') and ts >= '2024-01-05' and ts < '2024-01-12'"), "close"), f"SELECT symbol, {E()} AS ts, round(close, 6) AS close FROM bars WHERE symbol IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
add("q_2_1_21_refreshed_window", lambda s, d: rounded(bars(s, d).where("ts >= '2024-01-28 20:00:00' and ts < '2024-01-29 19:00:00'"), "open", "close", keys=("symbol", "ts", "volume")), f"SELECT symbol, {E()} AS ts, volume, round(open, 6) AS open, round(close, 6) AS close FROM bars WHERE ts >= TIMESTAMP '2024-01-28 20:00:00' AND ts < TIMESTAMP '2024-01-29 19:00:00'")
add("q_2_4_56_symbol_adv", lambda s, d: rounded(bars(s, d).withColumn("adv", R.mean(F.col("close") * F.col("volume"), 20)).groupBy("symbol").agg(F.coalesce(F.max_by("adv", "ts"), F.lit(1e6)).alias("adv")), "adv", keys=("symbol",), digits=4), "SELECT symbol, round(coalesce(last(adv ORDER BY ts), 1e6), 4) AS adv FROM av GROUP BY symbol", step("av", {"adv": "CASE WHEN count(close * volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN avg(close * volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END"}))
