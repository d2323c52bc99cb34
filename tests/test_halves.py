"""Values near half of the last decimal, and large ones, come out as DuckDB's round gives them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tapewright import registry
from tapewright.plans.build import rounded
from tests.test_oracles import canonical

QUOTES = [(1327997, "purchase", 0.34, 34), (553160, "view", 0.86, 2), (426208, "signup", 0.36, 11), (5208818, "view", 0.31, 98), (1018520, "view", 0.86, 47), (4124861, "error", 0.12, 1)]
PAIRS = [(1655665, "click", 19.2, 53), (1655683, "click", 9.26, 4), (5830596, "error", 6.4, 88), (5830598, "error", 19.77, 36), (3199220, "purchase", 13.05, 5), (3199225, "purchase", 19.46, 86), (5881091, "view", 24.15, 59), (5881112, "view", 118.6, 23)]
#: Quotes whose middle is almost 0.
NEAR = [(1236, "click", 4.671568835775532e-07, 99), (523249, "error", 0.25000867515659914, 68), (524246, "error", 3.9664625919855064e-07, 74), (824424, "purchase", 0.12500575890132426, 17)]


@pytest.mark.parametrize(("name", "rows"), [("q_2_11_12_book_record", QUOTES), ("q_2_8_47_imbalance_dynamics", PAIRS)])
def test_halves(spark, tmp_path, name, rows):
    values = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + to_seconds({i}), 1, '{s}', {v}::DOUBLE, '{{\"k\": {k}}}')" for i, s, v, k in rows)
    duck = duckdb.connect()
    duck.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {values}) AS t(event_id, ts, user_id, event_type, value, props)")
    duck.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    found = duck.execute(registry.oracle_sql()[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("digits", [4, 6, 12])
def test_rounded(spark, digits):
    values = [(2 * k + 1) / (2 * 10.0**digits) for k in range(-20001, 20001, 7)] + [k / 7 * 1e6 for k in range(1, 3000)] + [0.0, 1e300, float("inf"), float("-inf"), 4503599627.370497]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    found = {r["i"]: r["x"] for r in rounded(df, "x", keys=("i",), digits=digits).collect()}
    want = dict(duckdb.execute("SELECT i, round(x, $d) + 0.0 FROM (SELECT unnest($v) AS x, unnest(range(len($v))) AS i)", {"v": values, "d": digits}).fetchall())
    assert found == want
    plain = {r["i"]: r["x"] for r in df.withColumn("x", F.round("x", digits)).collect()}
    assert plain != want
    nan = spark.sql("SELECT double('NaN') AS x UNION ALL SELECT NULL")
    assert canonical(["x"], rounded(nan, "x", keys=()).collect()) == [("~",), ("~",)]


def test_large_spreads_of_snapshots(spark, tmp_path):
    test_halves(spark, tmp_path, "q_2_11_27_snapshot_features", NEAR)


def test_large_spreads_of_depth_features(spark, tmp_path):
    test_halves(spark, tmp_path, "q_2_8_46_depth_features", NEAR)
