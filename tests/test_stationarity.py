import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.operators import breaks as B
from tapewright.operators import selection as X
from tapewright.operators import stationarity as T


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name, phi in (("walk", 1.0), ("revert", 0.7), ("short", 0.5)):
        v = 50.0
        for k in range(14 if name == "short" else 400):
            v = 50 + phi * (v - 50) + rng.normal()
            rows.append((name, k, None if k == 7 else v))
    rows += [("flat", k, 3.0) for k in range(40)]
    p = pd.DataFrame(rows, columns=["symbol", "ts", "close"])
    return p, spark.createDataFrame([tuple(r) for r in rows], "symbol string, ts long, close double")


def plain_unit_root(x, lags):
    d = np.diff(x)
    rows = np.arange(lags, len(d))
    best = None
    for q in range(lags + 1):
        design = np.column_stack([np.ones(len(rows)), x[rows], *[d[rows - k] for k in range(1, q + 1)]])
        beta, *_ = np.linalg.lstsq(design, d[rows], rcond=None)
        squares = float(((d[rows] - design @ beta) ** 2).sum())
        free = len(rows) - design.shape[1]
        t = beta[1] / np.sqrt(squares / free * np.linalg.inv(design.T @ design)[1, 1])
        aic = len(rows) * np.log(squares / len(rows)) + 2 * design.shape[1]
        if best is None or aic < best[0] - 1e-6:
            best = (aic, q, t)
    return len(rows), best[1], best[2]


def test_unit_root_equals_a_regression(series):
    p, df = series
    got = {r["symbol"]: r for r in T.unit_root(df, "close", ["symbol"], lags=4).collect()}
    for name in ("walk", "revert"):
        n, q, t = plain_unit_root(p[p.symbol == name].close.dropna().to_numpy(), 4)
        assert (got[name]["n"], got[name]["lags"]) == (n, q) and got[name]["t"] == pytest.approx(t, rel=1e-6)
    assert got["revert"]["t"] < T.UNIT_ROOT_5 < got["walk"]["t"]
    assert got["flat"]["t"] is None


def test_kpss_equals_weighted_covariances(series):
    p, df = series
    for r in T.kpss(df, "close").collect():
        x = p[p.symbol == r["symbol"]].close.dropna().to_numpy()
        e = x - x.mean()
        n, lags = len(x), r["lags"]
        assert r["n"] == n and lags == min(int(np.ceil(12 * (n / 100) ** 0.25)), n - 1)
        long_run = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
        if long_run > 1e-12:
            assert r["kpss"] == pytest.approx((np.cumsum(e) ** 2).sum() / n**2 / long_run, rel=1e-9)


def test_minimum_difference(series):
    _, df = series
    got = {r["symbol"]: r for r in T.minimum_difference(df.where("symbol != 'flat'"), threshold=1e-3).collect()}
    assert got["revert"]["d"] == 0.0 and got["revert"]["correlation"] == pytest.approx(1.0)
    assert 0 < got["walk"]["d"] <= 1 and got["walk"]["found"] == 1
    assert "short" not in got  # no order leaves 20 values


def test_top_breaks_equal_the_walk(spark):
    rng = np.random.default_rng(9)
    rows = [(s, k, 100 + float(k), float(np.round(v, 1))) for s in ("a", "b", "c") for k, v in enumerate(rng.exponential(3, 120))]
    rows += [("up", k, 100 + float(k), float(k)) for k in range(200)] + [("none", k, 5.0 + k, 0.0) for k in range(9)]
    df = spark.createDataFrame(rows, "symbol string, ts long, close double, wald double").withColumn("r", F.try_divide("close", F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))) - 1)
    got = {}
    for r in B.top_breaks(df, limit=1.0, spacing=10).collect():
        got.setdefault(r["symbol"], set()).add((r["place"], r["wald"]))
    for s in {r[0] for r in rows}:
        own = [(v, k) for name, k, _, v in rows if name == s and k > 0]  # the first row has no return
        chosen = []
        for v, k in sorted(own, key=lambda x: (-x[0], x[1])):
            if v >= 1.0 and len(chosen) < 5 and all(abs(k - c) >= 10 for c, _ in chosen):
                chosen.append((k, v))
        assert got.get(s, set()) == set(chosen)


def test_eigenvalue_ratio_of_copies(spark):
    rng = np.random.default_rng(2)
    base = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 40)))
    rows = [(s, k, float(v * f)) for s, f in (("a", 1.0), ("b", 2.0)) for k, v in enumerate(base)]
    df = spark.createDataFrame(rows, "symbol string, ts long, close double").withColumn("ts", F.timestamp_seconds("ts"))
    got = [r["eigenvalue_ratio"] for r in B.eigenvalue_ratio(df, 10).collect()]
    assert len(got) == 29 and got == pytest.approx([1.0] * 29)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 500
    p = pd.DataFrame({c: rng.normal(size=n) for c in "abcd"})
    p["y"] = 2 * p.a - p.b + rng.normal(size=n)
    p["row"] = [f"r{k}" for k in range(n)]
    return p, spark.createDataFrame(p)


FEATURES = list("abcd")


def draws(text):
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def test_stability_selection_equals_a_loop(table):
    p, df = table
    counts = dict.fromkeys(FEATURES, 0)
    for k in range(20):
        u = np.array([draws(f"7:{k}:{r}") / 2**32 for r in p.row])
        w = sum((u >= c).astype(int) for c in X.POISSON)
        again = p.loc[np.repeat(np.arange(len(p)), w)]
        beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(again)), again[FEATURES]]), again.y, rcond=None)
        strength = np.abs(beta[1:]) * again[FEATURES].std(ddof=0).to_numpy()
        for i in np.argsort(-strength)[:2]:
            counts[FEATURES[i]] += 1
    got = {r["feature"]: r["stability"] for r in X.stability_selection(df, FEATURES, "y", "row", resamples=20, least=1).collect()}
    assert got == pytest.approx({f: c / 20 for f, c in counts.items()})


def test_permutation_importance_equals_numpy(table):
    p, df = table
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(p)), p[FEATURES]]), p.y, rcond=None)
    predict = lambda x: beta[0] + x[FEATURES].to_numpy() @ beta[1:]
    base = np.mean((p.y - predict(p)) ** 2)
    own = p.iloc[sorted(range(len(p)), key=lambda k: (draws(f"7:own:{p.row[k]}"), p.row[k]))].reset_index(drop=True)
    grown = {f: [] for f in FEATURES}
    for k in range(3):
        donors = p.iloc[sorted(range(len(p)), key=lambda j: (draws(f"7:{k}:{p.row[j]}"), p.row[j]))].reset_index(drop=True)
        for f in FEATURES:
            dealt = own.assign(**{f: donors[f]})
            grown[f].append(np.mean((own.y - predict(dealt)) ** 2) - base)
    model = X.linear_predictor(X.linear_model(df, FEATURES, "y"), FEATURES)
    got = {r["feature"]: r for r in X.permutation_importance(df, FEATURES, "y", "row", model, repeats=3).collect()}
    for f in FEATURES:
        assert got[f]["importance"] == pytest.approx(np.mean(grown[f])) and got[f]["sd"] == pytest.approx(np.std(grown[f]), abs=1e-9)


def test_elimination_equals_fits(table):
    p, df = table
    live, out = list(FEATURES), []
    while len(live) > 1:
        beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(p)), p[live]]), p.y, rcond=None)
        weak = live[int(np.argmin(np.abs(beta[1:]) * p[live].std(ddof=0).to_numpy()))]
        live.remove(weak)
        out.append(weak)
    got = {r["feature"]: r["place"] for r in X.eliminated(df, FEATURES, "y", 1).collect()}
    assert got == {live[0]: 1, **{f: len(out) - k + 1 for k, f in enumerate(out)}}


def test_projected_pairs_find_what_all_pairs_find(spark):
    """Sixteen groups of three symbols around a walk of their own, one of each against it: at least 0.9 of the pairs that the exact search finds in groups.

    Pairs of unrelated walks that pass the test by chance are not looked for."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(16):
        walk = 100 + np.cumsum(rng.normal(size=300))
        for k, side in enumerate((1, 1, -1)):
            noise = [0.0]
            for e in rng.normal(scale=0.25, size=299):
                noise.append(0.7 * noise[-1] + e)  # a half-life of about two rows
            rows += [(f"g{g:02d}{k}", t, float(200 + side * walk[t] + noise[t])) for t in range(300)]
    df = spark.createDataFrame(rows, "symbol string, ts long, close double").cache()
    pairs = T.projected_pairs(df).cache()
    close = {(r["a"], r["b"]) for r in pairs.collect()}
    assert len(close) < 0.25 * 48 * 47 / 2
    exact = {(r["a"], r["b"]): r["t"] for r in T.pair_search(df).collect()}
    got = {(r["a"], r["b"]): r["t"] for r in T.pair_search(df, pairs).collect()}
    planted = {p for p in exact if p[0][:3] == p[1][:3]}
    assert len(planted) >= 40 and len(planted & set(got)) >= 0.9 * len(planted)
    assert set(got) == set(exact) & close and all(got[p] == pytest.approx(exact[p], rel=1e-6) for p in got)


def test_pair_search_of_nothing(spark):
    none = spark.createDataFrame([("a", 1, None), ("b", 1, 0.0), (None, 1, 2.0)], "symbol string, ts long, close double")
    assert T.projected_pairs(none).count() == 0 and T.pair_search(none).count() == 0
    assert T.pair_search(none.where("false"), T.projected_pairs(none.where("false"))).count() == 0
