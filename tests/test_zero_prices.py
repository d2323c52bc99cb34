"""Prices of 0: queries whose SQL divides by them, or takes their logarithm, give what IEEE 754 and DuckDB give."""

import datetime
import math
import os
import shutil

import duckdb
import numpy as np
import pytest

from tapewright import registry
from tapewright.functions import rolling as R
from tapewright.operators import information as I
from tapewright.operators import statistics as S
from tests.test_oracles import canonical

DIVIDING = [
    "flagship", "q_2_11_12_book_record", "q_2_11_27_snapshot_features", "q_2_11_28_snapshot_imbalances", "q_2_12_7_execution_shift", "q_2_13_16_stacking", "q_2_3_10_as_of_query",
    "q_2_3_11_as_of_returns", "q_2_3_31_as_of_panel", "q_2_3_9_known_adjustment", "q_2_4_100_recursive_elimination", "q_2_4_101_permutation_importance", "q_2_4_102_joint_dependence",
    "q_2_4_102_partial_dependence", "q_2_4_103_fold_stability", "q_2_4_125_model_health", "q_2_4_54_model_decay", "q_2_4_74_prediction_drift", "q_2_4_75_performance_drift",
    "q_2_4_93_correlation_selection", "q_2_4_96_stability_selection", "q_2_4_97_combined_selection", "q_2_4_98_adversarial_selection", "q_2_4_99_temporal_selection", "q_2_6_13_log_returns",
    "q_2_7_10_yang_zhang", "q_2_7_8_garman_klass", "q_2_7_9_parkinson", "q_2_8_46_depth_features", "q_2_8_47_imbalance_dynamics", "q_2_8_57_eigenvalue_ratio",
]


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """sf0.01 with events of which every 499th has a price of 0, none of them in the first tenth."""
    folder = tmp_path_factory.mktemp("zeros")
    for name in os.listdir("/root/testdata/sf0.01"):
        if name != "events.parquet":
            shutil.copy(f"/root/testdata/sf0.01/{name}", folder / name)
    duckdb.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 499 = 498 AND event_id > 1000 THEN 0.0 ELSE value END AS value) FROM '/root/testdata/sf0.01/events.parquet') TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", DIVIDING)
def test_zero_prices(spark, zeros, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{zeros}/events.parquet'")
    df = registry.queries()[name](spark, zeros)
    found = duck.execute(registry.oracle_sql()[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([d[0] for d in found.description], found.fetchall())


def test_mutual_information_of_zero_prices(spark, zeros):
    """The SQL casts NaN to a whole number there, which DuckDB refuses; every feature keeps its finite rows."""
    rows = registry.queries()["q_2_4_95_mutual_information"](spark, zeros).collect()
    assert len(rows) == 5 and all(math.isfinite(r["information"]) for r in rows)
    n = {r["feature"]: r["n"] for r in rows}
    assert n["momentum"] < n["volume"]


def test_information_leaves_out_infinities(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=60), rng.normal(size=60)
    pairs = [(float(a), float(b)) for a, b in zip(x, y, strict=True)]
    odd = [(math.inf, 1.0), (-math.inf, 0.0), (math.nan, 2.0), (0.5, math.inf), (0.1, math.nan)]
    one = lambda p: I.mutual_information(spark.createDataFrame(p, "x double, y double"), ["x"], "y").collect()
    assert one(pairs + odd) == one(pairs)


def test_quotients_and_logarithms(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0), (6.0, 3.0), (None, 0.0), (math.inf, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    found = [tuple(r) for r in df.select(R.quotient("a", "b"), R.log("a")).collect()]
    nan = math.nan
    assert repr(found) == repr([(math.inf, 0.0), (-math.inf, nan), (nan, -math.inf), (-math.inf, 0.0), (2.0, math.log(6)), (None, None), (math.inf, math.inf)])


def test_order_buckets_hold_infinities(spark):
    values = [-math.inf, -1e308, -1.0, 0.0, 5e-324, 1.0, 1e308, math.inf, math.nan]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(R.order_bucket("x")).collect()]
    assert found == sorted(found) and len(set(found)) == len(found)


def test_triple_barrier_of_zero_prices(spark, zeros):
    test_zero_prices(spark, zeros, "q_2_8_76_triple_barrier")
    rows = registry.queries()["q_2_8_76_triple_barrier"](spark, zeros).where("barrier_label is not null").count()
    assert rows > 1000


@pytest.mark.parametrize("after", [0.0, 100.0])
def test_triple_barrier_after_a_zero(spark, after):
    """From 0, a price above it is an infinite return and another 0 is NaN, which exceeds every number: both touch the upper barrier."""
    closes = [100.0 + i % 3 for i in range(25)] + [0.0, after] + [100.0 + i % 3 for i in range(15)]
    rows = [("A", datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=15 * i), c) for i, c in enumerate(closes)]
    found = S.triple_barrier(spark.createDataFrame(rows, "symbol string, ts timestamp, close double")).orderBy("ts").collect()
    assert [r["barrier_label"] for r in found[24:27]] == [-1, 1, None]
