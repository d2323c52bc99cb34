import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import stacking as K
from tapewright.operators import views as V
from tapewright.sources.tables import rollup
from tapewright.streaming import incremental, orders
from tapewright.streaming import late as L

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_historical_features(spark):
    entities = spark.createDataFrame([("a", at(m), m) for m in (0, 10, 29, 30, 100, 1500, 4000)] + [("b", at(5), 1005), (None, at(50), 2050), ("a", at(30), 30)], "symbol string, ts timestamp, id long")
    prices = [("a", at(10), at(10), 1.0), ("a", at(20), at(20), 2.0), ("a", at(10), at(30), 9.0), ("a", at(20), at(100), 8.0), (None, at(40), at(45), 5.0), ("a", at(90), at(2000), 7.0)]
    v = spark.createDataFrame(prices, "symbol string, ts timestamp, known timestamp, price double")
    w = spark.createDataFrame([("a", at(0), 100, None), ("b", at(6), 1, "x")], "symbol string, ts timestamp, size long, kind string")
    out = V.historical_features(entities, [V.FeatureView("p", v, ["price"], 3600, "known"), V.FeatureView("s", w, ["size", "kind"])])
    got = sorted((r["id"], r["p__price"], r["s__size"], r["s__age"]) for r in out.collect())
    # 30: the correction of minute 10 doesn't replace minute 20's value; 100: minute 20's value is too old; 4000: known since 2000, but older than an hour
    assert got == [(0, None, 100, 0), (10, 1.0, 100, 600), (29, 2.0, 100, 1740), (30, 2.0, 100, 1800), (30, 2.0, 100, 1800), (100, None, 100, 6000), (1005, None, None, None), (1500, None, 100, 90000), (2050, 5.0, None, None), (4000, None, 100, 240000)]
    free = V.historical_features(entities, [V.FeatureView("p", v, ["price"], None, "known")], slab_seconds=600)
    assert {(r["id"], r["p__price"]) for r in free.collect()} >= {(100, 8.0), (1500, 8.0), (4000, 7.0)}


def test_materialised_view(spark, tmp_path):
    rows = spark.createDataFrame([("a", at(0), 1.0), ("a", at(1500), 2.0)], "symbol string, ts timestamp, x double")
    view = V.FeatureView("v", rows, ["x"])
    V.materialised(view, f"file://{tmp_path}/v")
    again = V.materialised(V.FeatureView("v", rows.where("x = 2").withColumn("x", F.lit(5.0)), ["x"]), f"file://{tmp_path}/v")
    assert sorted(r["x"] for r in again.rows.collect()) == [1.0, 5.0]


def test_no_row_sees_its_own_label(spark):
    rng = np.random.default_rng(1)
    rows = [("s", at(k), float(a), float(b), float(a + rng.normal())) for k, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    schema = "symbol string, ts timestamp, a double, b double, y double"
    models = {"one": ["a"], "two": ["a", "b"]}
    before = {r["ts"]: r for r in K.out_of_fold(spark.createDataFrame(rows, schema), models, "y").collect()}
    changed = [(*r[:4], r[4] + 1000.0) if k == 77 else r for k, r in enumerate(rows)]
    after = {r["ts"]: r for r in K.out_of_fold(spark.createDataFrame(changed, schema), models, "y").collect()}
    assert before[at(77)]["one"] == after[at(77)]["one"] and before[at(77)]["two"] == after[at(77)]["two"]
    assert before[at(78)]["one"] == after[at(78)]["one"]  # of the same fold
    assert before[at(10)]["one"] != after[at(10)]["one"]
    p = np.array([r[2:5] for r in rows])
    train = [k for k in range(200) if k < 75 or k >= 125]  # the third fold of five is 80 to 119, 5 rows around it left out
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(train)), p[train, 0]]), p[train, 2], rcond=None)
    assert before[at(90)]["one"] == pytest.approx(beta[0] + beta[1] * p[90, 0])
    out, fit = K.stacked(spark.createDataFrame(rows, schema), models, "y")
    meta = np.array([(r["one"], r["two"], r["y"]) for r in before.values()])
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(meta)), meta[:, :2]]), meta[:, 2], rcond=None)
    assert fit.first()["beta"] == pytest.approx(beta.tolist()) and out.count() == 200


def ticks_of(spark, n=300):
    rng = random.Random(4)
    return [("ab"[k % 2], at(rng.randrange(0, 600)), k, float(rng.randrange(1, 50)), rng.randrange(1, 9)) for k in range(n)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_late_rows_correct_the_bars(spark, tmp_path, seed):
    rows = ticks_of(spark)
    order = sorted(rows, key=lambda r: r[1]) if seed == 0 else random.Random(seed).sample(rows, len(rows))
    schema = "symbol string, ts timestamp, seq long, price double, size long"
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for k in range(5):
        spark.createDataFrame(order[60 * k : 60 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    L.corrected_rollup(stream, path).awaitTermination()
    expected = {(r["symbol"], r["ts"]): tuple(r[c] for c in ("open", "high", "low", "close", "volume", "trade_count")) for r in rollup(spark.createDataFrame(rows, schema), "15 minutes").collect()}
    got = L.corrected_bars(spark, path).collect()
    assert {(r["symbol"], r["ts"]): tuple(r[c] for c in ("open", "high", "low", "close", "volume", "trade_count")) for r in got} == expected
    assert sum(r["late_count"] for r in got) == 0 if seed == 0 else sum(r["late_count"] for r in got) > 100
    # a batch that is run again replaces its own parts
    again = spark.createDataFrame(order[60:120], schema)
    L.partial_bars(again, "15 minutes").withColumn("late", F.lit(False)).write.mode("overwrite").parquet(f"{path}/parts/batch=1")
    whole = L.compacted(spark, path, f"{path}/compact")
    assert {(r["symbol"], r["ts"]): tuple(r[c] for c in ("open", "high", "low", "close", "volume", "trade_count")) for r in L.merged_bars(whole).collect()} == expected


def test_drift_monitor(spark, tmp_path):
    rng = np.random.default_rng(6)
    schema = "symbol string, price double"
    base = [(s, float(v)) for s in "ab" for v in rng.normal(size=20_000)]
    shifted = [("a", float(v)) for v in rng.normal(size=30_000)] + [("b", float(v) + 0.7) for v in rng.normal(size=30_000)]
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame(shifted, schema).repartition(6).write.parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    L.drift_monitor(stream, spark.createDataFrame(base, schema), "symbol", "price", path, k=400).awaitTermination()
    got = {r["symbol"]: r for r in L.latest_drift(spark, path).collect()}
    for s in "ab":
        x, y = np.sort([v for n, v in base if n == s]), np.sort([v for n, v in shifted if n == s])
        both = np.concatenate([x, y])
        ks = np.abs(np.searchsorted(x, both, "right") / len(x) - np.searchsorted(y, both, "right") / len(y)).max()
        assert got[s]["n"] == len(y) and abs(got[s]["ks"] - ks) < 1 / L.POINTS + 2 * 2.3 / 400**0.9
    assert got["a"]["alert"] == "ok" and got["b"]["alert"] == "critical"
    sizes = L.sketches(spark.createDataFrame(shifted, schema), "symbol", "price", 400).selectExpr("max(length(sketch))").first()[0]
    assert sizes < 20_000  # 30,000 values are 240 kB


def test_book_equals_a_scan_of_all_orders():
    rng = random.Random(3)
    book, live = orders.Book(), {}
    for _ in range(3000):
        o, action, bid, p, q = rng.randrange(60), rng.choice(["add", "modify", "delete"]), rng.random() < 0.5, float(rng.randrange(30)), float(rng.randrange(1, 9))
        live.pop(o, None)
        if action != "delete":
            live[o] = (bid, p, q)
        got = book.update(o, action, bid, p, q)
        bids, asks = [x[1:] for x in live.values() if x[0]], [x[1:] for x in live.values() if not x[0]]
        best = [(max(s)[0] if k == 0 else min(s)[0]) if s else None for k, s in enumerate((bids, asks))]
        sizes = [sum(q for p, q in s if p == b) if s else None for s, b in zip((bids, asks), best, strict=True)]
        assert [None if v != v else v for v in got] == [len(live), *best, *sizes]
        if rng.random() < 0.01:
            book = orders.Book(dict(book.orders))  # as after a micro-batch
    assert all(len(s.heap) <= 3000 for s in book.sides.values())


def test_small_state_gives_the_same_rows(spark):
    sf = "/root/testdata/sf0.001"
    one, many = (sorted(map(tuple, incremental.drained(orders.order_book(orders.order_ticks(spark, sf, n)), "orders").collect()), key=str) for n in (1, 5))
    assert str(one) == str(many) and len(one) == 1000


def test_permutations_of_batches_merge_alike(spark):
    parts = [L.partial_bars(spark.createDataFrame(ticks_of(spark)[k::3], "symbol string, ts timestamp, seq long, price double, size long"), "15 minutes").withColumn("late", F.lit(False)) for k in range(3)]
    made = {str(sorted(map(tuple, L.merged_bars(a.union(b).union(c)).collect()))) for a, b, c in itertools.permutations(parts)}
    assert len(made) == 1
