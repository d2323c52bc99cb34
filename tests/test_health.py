import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.operators import health as H


def plain_ks(x, y):
    both = np.concatenate([x, y])
    return np.abs(np.searchsorted(np.sort(x), both, "right") / len(x) - np.searchsorted(np.sort(y), both, "right") / len(y)).max()


def test_probability_of_a_distance(spark):
    row = spark.range(1).select(*[H.kolmogorov(F.lit(z / 10), F.lit(200.0), F.lit(200.0)).alias(f"p{k}") for k, z in enumerate((0.0, 0.8276, 1.3581, 1.6276, 5.0))]).first()
    # distances times sqrt(100): 0, 0.8276, 1.3581 and 1.6276 are the points of 1, 0.5, 0.05 and 0.01
    assert list(row) == pytest.approx([1.0, 0.5, 0.05, 0.01, 0.0], abs=2e-4)


def test_window_drift(spark):
    rng = np.random.default_rng(8)
    rows = [("same", k, k, float(v)) for k, v in enumerate(rng.normal(size=500))] + [("moved", k, k, float(v) + (2 if k > 300 else 0)) for k, v in enumerate(rng.normal(size=500))] + [("short", k, k, 1.0) for k in range(9)]
    got = {r["feature"]: r for r in H.window_drift(spark.createDataFrame(rows, "feature string, ts long, tie long, value double"), 200, 100).collect()}
    for name in ("same", "moved"):
        v = np.array([r[3] for r in rows if r[0] == name])
        assert got[name]["ks"] == pytest.approx(plain_ks(v[:200], v[-100:])) and got[name]["ref_mean"] == pytest.approx(v[:200].mean())
    assert (got["same"]["drifted"], got["moved"]["drifted"]) == (0, 1)
    assert got["short"]["drifted"] == 0 if "short" in got else True


def test_percentiles_with_ties_and_groups(spark):
    rng = np.random.default_rng(2)
    v = {"a": np.where(rng.random(301) < 0.6, 0.0, rng.normal(size=301)), "b": rng.exponential(size=50) * 1e6, None: np.array([4.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in v.items() for x in xs] + [("a", None)], "g string, x double")
    shares = (0.0, 0.05, 0.5, 0.77, 1.0)
    got = {r["g"]: r["q"] for r in R.percentiles(df, "x", shares, ["g"]).collect()}
    assert got == {g: pytest.approx(np.quantile(xs, shares).tolist()) for g, xs in v.items()}
    assert R.percentiles(df.drop("g"), "x", shares).first()["q"] == pytest.approx(np.quantile(np.concatenate(list(v.values())), shares).tolist())


def test_breaking_points_and_components(spark):
    positions = spark.createDataFrame([("a", 0.6, 1.5, 0.01), ("b", 0.4, 0.5, 0.02)], "symbol string, weight double, market double, size double")
    got = {r["factor"]: r["breaking_point"] for r in H.breaking_points(positions, ["market", "size"]).collect()}
    assert got["market"] == pytest.approx(0.2 / 1.1, abs=1e-6) and got["size"] is None
    rng = np.random.default_rng(3)
    r = rng.normal(size=(60, 2)) @ np.array([[0.02, 0.01], [0.0, 0.03]])
    returns = spark.createDataFrame([(k, s, float(r[k, i])) for k in range(60) for i, s in enumerate("ab")] + [(99, "a", 5.0)], "ts long, symbol string, r double")
    w, cov = np.array([0.6, 0.4]), np.cov(r.T)
    sd = math.sqrt(w @ cov @ w)
    rows = {x["symbol"]: x for x in H.component_risk(returns, positions.select("symbol", "weight")).collect()}
    assert [rows[s]["component"] for s in "ab"] == pytest.approx((1.6448536269514722 * w * (cov @ w) / sd).tolist())
    assert sum(x["share"] for x in rows.values()) == pytest.approx(1.0)


def test_health_score(spark):
    flags = lambda *v: spark.createDataFrame([(x,) for x in v], "drifted long")
    alerts = spark.createDataFrame([(k, k, "critical" if k in (1, 58, 59) else "info") for k in range(60)], "ts long, tie long, level string")
    row = H.model_health(flags(1), flags(1, 0, 1), alerts).first()
    assert (row["health"], row["n_critical"], row["urgent"]) == (50.0, 2, 0)
    assert H.model_health(flags(0), flags(*[1] * 9), alerts.where("false")).first()["health"] == 70.0
