import numpy as np
import pandas as pd
import pytest

from tapewright.operators import information as I


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 3000
    y = rng.normal(size=n)
    p = pd.DataFrame({
        "noise": rng.normal(size=n), "line": y + rng.normal(size=n), "square": y * y + 0.1 * rng.normal(size=n), "mostly_zero": np.where(rng.random(n) < 0.7, 0.0, y),
        "few": np.round(y), "tail": np.exp(3 * rng.normal(size=n)) * np.sign(y), "constant": 1.0, "y": y,
    })
    p.loc[10:40] = p.loc[10].to_numpy()  # repeated rows
    return p, spark.createDataFrame(p)


@pytest.mark.parametrize("cell_rows", [40, 300, 10_000])
def test_mutual_information(table, cell_rows):
    p, df = table
    features = [c for c in p.columns if c != "y"]
    got = {r["feature"]: r["information"] for r in I.mutual_information(df, features, "y", cell_rows=cell_rows).collect()}
    for c in features:
        assert got[c] == pytest.approx(I.plain_information(p[c], p["y"]), abs=1e-6), c
    assert got["line"] > 0.2 and got["noise"] < 0.05


def test_mutual_information_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, None, 2.0), (None, 1.0, 3.0), (4.0, 1.0, 9.0), (5.0, 7.0, 1.0)], "a double, b double, y double")
    got = {r["feature"]: (r["n"], r["information"]) for r in I.mutual_information(df, ["a", "b"], "y").collect()}
    assert got["a"][0] == 4 and got["a"][1] is not None and got["b"] == (4, got["b"][1])
    assert I.mutual_information(df.where("false"), ["a", "b"], "y").count() == 0


def test_nearest():
    rng = np.random.default_rng(1)
    points, queries = rng.integers(0, 50, (300, 2)), rng.integers(-5, 60, (80, 2))
    expected = np.sort(np.abs(points[None] - queries[:, None]).max(2), axis=1)[:, :4]
    assert (I.nearest(points, queries, 4) == expected).all()
    assert (I.nearest(points[:2], queries, 4)[:, 2:] == I.FAR).all()
