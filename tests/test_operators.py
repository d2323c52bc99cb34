"""Hand values and properties of the operators on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.functions.ema import BLOCK, alpha, ema
from tapewright.functions.ordered import fold
from tapewright.operators import book, checks, costs, evaluation, joins, microstructure, momentum, recurrences, statistics, trend, volatility
from tapewright.streaming.incremental import Features


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(42)
    n = 700
    close = 100 * np.cumprod(1 + rng.normal(0.0005, 0.02, n))
    rows = [("A", (pd.Timestamp("2023-01-01") + pd.Timedelta(minutes=15 * i)).to_pydatetime(), float(c * 1.001), float(c * (1 + abs(rng.normal(0, 0.01)))), float(c * (1 - abs(rng.normal(0, 0.01)))), float(c), int(rng.integers(1e4, 1e6))) for i, c in enumerate(close)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume long").cache()
    return df, pd.DataFrame(rows, columns=df.columns)


def column(df, name):
    return [r[0] for r in df.orderBy("ts").select(name).collect()]


@pytest.mark.parametrize("span", [1, 1.01, 5, 26, 200])
@pytest.mark.parametrize("adjust", [False, True])
def test_ema_equals_pandas_across_blocks(series, span, adjust):
    df, p = series
    assert len(p) > 2 * BLOCK
    got = column(ema(df, {"e": ("close", alpha(span))}, adjust=adjust), "e")
    assert np.allclose(got, p.close.ewm(span=span, adjust=adjust).mean(), rtol=1e-10)


def test_ema_starts_at_the_first_value(series):
    df, p = series
    got = column(ema(df.withColumn("d", R.change("close")), {"e": ("d", alpha(9))}), "e")
    want = p.close.diff().ewm(span=9, adjust=False).mean()
    assert got[0] is None and np.allclose(got[1:], want[1:])


def test_rolling_equals_pandas(series):
    df, p = series
    got = np.array(column(trend.sma(df, 20), "sma_20"), float)
    assert np.isnan(got[:19]).all() and np.allclose(got[19:], p.close.rolling(20).mean()[19:])
    got = np.array(column(statistics.moments(df, 20), "skew_20"), float)
    assert np.allclose(got[20:], p.close.pct_change().rolling(20).skew()[20:])
    got = np.array(column(statistics.moments(df, 20), "kurt_20"), float)
    assert np.allclose(got[20:], p.close.pct_change().rolling(20).kurt()[20:])


def test_bounds(series):
    df, _ = series
    rsi = [x for x in column(momentum.rsi(df), "rsi_14") if x is not None]
    assert 0 <= min(rsi) and max(rsi) <= 100
    b = volatility.bollinger(df).where("bb_middle is not null")
    assert b.where("bb_upper < bb_middle or bb_lower > bb_middle").count() == 0


@pytest.mark.parametrize("operator", [trend.macd, trend.adx, momentum.tsi, momentum.stochastic, volatility.keltner, volatility.mfi, statistics.drawdown, recurrences.sar, recurrences.kama, recurrences.mean_reversion])
def test_no_look_ahead(series, operator):
    """Values don't change when later rows are taken away."""
    df, p = series
    cut = p.ts[400].to_pydatetime()
    whole = operator(df).where(F.col("ts") <= F.lit(cut)).orderBy("ts").toPandas()
    part = operator(df.where(F.col("ts") <= F.lit(cut))).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(whole, part)


def test_parabolic_sar_stays_on_its_side(series):
    df, _ = series
    s = recurrences.sar(df).join(df, ["symbol", "ts"])
    assert s.where("(sar_trend = 1 and sar > high) or (sar_trend = -1 and sar < low)").count() == 0
    assert s.select("sar_trend").distinct().count() == 2


def test_fold_keeps_series_apart(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 5.0), ("a", 2, 2.0), ("b", 2, 6.0)], "symbol string, ts int, x double")
    got = fold(df, ["x"], lambda s, x: ((s or 0) + x, ((s or 0) + x,)), {"total": "double"}).collect()
    assert sorted((r.symbol, r.ts, r.total) for r in got) == [("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 5.0), ("b", 2, 11.0)]


def test_as_of_takes_the_right_side_on_equal_times(spark):
    left = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:20:00"), ("b", "2024-01-01 00:10:00")], "symbol string, t string").select("symbol", F.col("t").cast("timestamp").alias("ts"))
    right = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:15:00", 2.0)], "symbol string, t string, v double").select("symbol", F.col("t").cast("timestamp").alias("ts"), "v")
    got = {(r.symbol, r.ts.minute): r.v for r in joins.as_of(left, right, "v").collect()}
    assert got == {("a", 10): 1.0, ("a", 20): 2.0, ("b", 10): None}
    assert {(r.symbol, r.ts.minute): r.v for r in joins.as_of(left, right, "v", ttl_seconds=60).collect()}["a", 20] is None


def test_purged_folds(series):
    df, p = series
    f = joins.folds(df, 5, purge=10, embargo=20).toPandas()
    assert (f[f.role == "test"].groupby("fold").size().sum()) == len(p)
    for _, g in f.groupby("fold"):
        test, train = g[g.role == "test"].row, g[g.role == "train"].row
        assert not set(test) & set(train)
        assert all(t < test.min() - 10 or t >= test.max() + 20 for t in train)


def test_book_values(spark):
    b = spark.createDataFrame([("x", [(100.0, 20.0), (99.0, 50.0)], [(101.0, 180.0), (102.0, 10.0)])], f"symbol string, bids array<{book.LEVEL}>, asks array<{book.LEVEL}>")
    r = book.measures(b).first()
    assert r.imbalance_1 == pytest.approx((20 - 180) / 200) and r.mid == 100.5 and r.crossed == 0
    assert r.microprice == pytest.approx((100 * 180 + 101 * 20) / 200) and r.sweep_price == 101 and r.sweep_filled == 100


def test_chain_finds_the_first_change(spark):
    e = spark.createDataFrame([(1, i, f"e{i}") for i in range(5)], "account long, id long, what string")
    c = book.chained(e, ["id", "what"], "account", "id")
    assert book.verify_chain(c, ["id", "what"], "account", "id").first().n_bad == 0
    assert c.orderBy("id").first().previous_hash == "GENESIS"
    broken = c.withColumn("what", F.when(F.col("id") == 2, "x").otherwise(F.col("what")))
    assert book.verify_chain(broken, ["id", "what"], "account", "id").first().first_bad == 2


def test_incremental_features_equal_pandas(series):
    _, p = series
    f = Features()
    got = pd.DataFrame([f.update(x) for x in p.close], columns=Features.COLUMNS)
    assert np.allclose(got.ema_12, p.close.ewm(span=12, adjust=False).mean())
    assert np.allclose(got.sd_20[19:], p.close.rolling(20).std()[19:]) and got.rsi_14.between(0, 100).all()


def test_windows_are_made_on_use():
    """Modules can be imported where there is no session, as in Python workers."""
    import subprocess
    import sys

    code = "import tapewright.registry as r; assert len(r.queries()) > 200; import pyspark; assert pyspark.SparkContext._active_spark_context is None"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0


def test_transitions_and_ages(spark):
    rows = [("x", i, s) for i, s in enumerate("aabaab")]
    df = spark.createDataFrame(rows, "symbol string, ts long, state string")
    got = {(r.state, r.after): (r.n, round(r.p, 6)) for r in evaluation.transitions(df).collect()}
    assert got == {("a", "a"): (2, 0.5), ("a", "b"): (2, 0.5), ("b", "a"): (1, 1.0)}
    assert [r.age for r in evaluation.regime_age(df).orderBy("ts").collect()] == [0, 1, 0, 0, 1, 0]
    assert {r.state: r.mean_length for r in evaluation.regime_durations(df).collect()} == {"a": 2.0, "b": 1.0}


def test_costs_by_hand(spark):
    df = spark.createDataFrame([(100.0, 1.0, 0.0), (100.0, -1.0, 0.6)], "price double, side double, p double")
    price, side, p = (F.col(c) for c in df.columns)
    got = df.select(costs.simple_fill(price, side, 100.0), costs.shifted(price, side, F.lit(50.0)), costs.bet_size(p, side), costs.volatility_scaled(side, F.lit(0.6))).collect()
    assert [tuple(round(x, 6) for x in r) for r in got] == [(101.0, 100.5, 0.0, 0.25), (99.009901, 99.5, -0.2, -0.25)]


def test_checks_of_an_empty_table(spark):
    df = spark.createDataFrame([], "symbol string, ts timestamp, open double, high double, low double, close double, volume long")
    for f in (checks.missing, checks.relations, checks.prices, checks.volumes, checks.time_gaps, checks.summary, checks.backtest_input, checks.quick, checks.possible_splits):
        assert f(df).count() == 0


def plain_sar(high, low, first=0.02, step=0.02, most=0.2):
    """Wilder's rules, written down anew: (stop, trend) per bar."""
    out, trend, stop, extreme, pace = [(high[0], -1)], -1, high[0], low[0], first
    for i in range(1, len(high)):
        stop += pace * (extreme - stop)
        before = slice(max(0, i - 2), i)
        stop = min(stop, *low[before]) if trend > 0 else max(stop, *high[before])
        crossed = low[i] < stop if trend > 0 else high[i] > stop
        if crossed:
            trend, stop, pace = -trend, extreme, first
            extreme = high[i] if trend > 0 else low[i]
        elif (high[i] > extreme) if trend > 0 else (low[i] < extreme):
            extreme, pace = (high[i] if trend > 0 else low[i]), min(pace + step, most)
        out.append((stop, trend))
    return out


def test_parabolic_sar_by_its_rules(series):
    df, p = series
    got = recurrences.sar(df).orderBy("ts").collect()
    want = plain_sar(p.high.tolist(), p.low.tolist())
    assert np.allclose([r.sar for r in got], [w[0] for w in want]) and [r.sar_trend for r in got] == [w[1] for w in want]


def test_liquidity_measures_equal_pandas(series):
    df, p = series
    r = p.close.pct_change()
    amihud = (r.abs() / (p.close * p.volume) * 1e6).rolling(20, min_periods=5).mean()
    got = microstructure.liquidity_score(df).orderBy("ts").toPandas()
    assert np.allclose(got.amihud_log, np.log(amihud.replace(0, np.nan)), equal_nan=True)
    z = lambda x: (x - x.rolling(60).mean()) / x.rolling(60).std()
    want = (z(got.roll_spread_pct.astype(float)).fillna(0) + z(np.log(amihud)).fillna(0)) / 2
    assert np.allclose(got.liquidity_score, want, atol=1e-4)
    side = (p.close - p.low) / (p.high - p.low) - 0.5
    block = p.volume > p.volume.rolling(50).quantile(0.95)
    buys, sells = (((p.volume * block) * hit).rolling(50).sum() for hit in (side > 0, side < 0))
    impact = (r.abs() * block).rolling(50).mean() / (r.abs() * ~block).rolling(50).mean().replace(0, np.nan)
    got = microstructure.smart_money(df).orderBy("ts").toPandas()
    assert np.allclose(got.smart_money_index, ((buys - sells) / (buys + sells).replace(0, np.nan)).fillna(0), atol=1e-9)
    assert np.allclose(got.institutional_activity, (block.rolling(50).mean() * 0.5 + impact.clip(0, 2) / 4).fillna(0), atol=1e-9)


def test_ease_of_movement_counts_flat_bars_as_zero(series):
    df, p = series
    flat = df.withColumns({"high": F.when(F.minute("ts") == 0, F.col("close")).otherwise(F.col("high")), "low": F.when(F.minute("ts") == 0, F.col("close")).otherwise(F.col("low"))})
    q = flat.orderBy("ts").toPandas()
    mid = (q.high + q.low) / 2
    with np.errstate(divide="ignore"):
        want = (mid.diff() / (q.volume / (q.high - q.low))).rolling(14).mean()
    assert np.allclose(column(volatility.ease_of_movement(flat).withColumn("e", F.coalesce("eom_14", F.lit(float("nan")))), "e"), want, equal_nan=True, atol=1e-12)
