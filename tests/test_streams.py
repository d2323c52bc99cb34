"""Streams whose state follows time: micro-batches of bounded size, one after the other, with the batch's results."""

import time

import numpy as np
import pandas as pd

from tapewright.sources.tables import ticks
from tapewright.streaming import incremental as I

SF = "/root/testdata/sf0.01"


def test_micro_batches_are_bounded_and_follow_time(spark, tmp_path):
    seen = []
    stream = I.timed_tick_stream(spark, SF, rows=1500)
    note = lambda df, _: seen.append(df.selectExpr("count(*)", "min(struct(ts, seq))", "max(struct(ts, seq))").first())
    q = stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = [r for r in seen if r[0]]
    assert sum(r[0] for r in seen) == 10_000 and len(seen) >= 5
    assert max(r[0] for r in seen) <= 3000
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))


def test_features_of_many_micro_batches_equal_the_batch(spark):
    a = I.drained(I.feature_stream(I.timed_tick_stream(spark, SF, rows=1500)), "features")
    b = I.feature_batch(ticks(spark, SF))
    columns = ["symbol", "seq", *I.Features.COLUMNS]
    assert sorted(a.select(columns).collect()) == sorted(b.select(columns).collect())


def test_ties_of_time_are_ordered_in_the_batch(spark):
    rows = [("a", "2024-01-01", k, float(k * k % 7)) for k in range(50)]
    df = spark.createDataFrame(rows[::-1], "symbol string, ts string, seq long, price double")
    found = I.feature_batch(df).select("seq", "ema_12").collect()
    f = I.Features()
    assert [tuple(r) for r in sorted(found)] == [(k, f.update(p)[0]) for _, _, k, p in rows]


def test_rows_are_given_out_in_parts():
    n = 2 * I.GIVEN_ROWS + 5
    frame = pd.DataFrame({"symbol": "a", "ts": range(n), "seq": range(n), "price": 1.0})
    parts = list(I._ordered(iter([frame[n // 2 :], frame[: n // 2]])))
    assert [len(p) for p in parts] == [I.GIVEN_ROWS, I.GIVEN_ROWS, 5] and list(pd.concat(parts)["seq"]) == list(range(n))


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], I.EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    assert I.drained(I.feature_stream(I.timed_tick_stream(spark, str(tmp_path))), "features").collect() == []


class Held:
    """The state of one symbol, as the stream hands it to a micro-batch."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def updates(n, levels, seed=4):
    rng = np.random.default_rng(seed)
    price = rng.integers(0, levels, n).astype(float)
    return pd.DataFrame({"ts": range(n), "seq": range(n), "side": np.where(price < levels / 2, "bid", "ask"), "price": price, "size": np.where(rng.random(n) < 0.3, 0.0, 1.0)})


def test_book_of_many_micro_batches_equals_all_levels_read_through():
    rows, state = updates(2000, 40), Held()
    rows.loc[5::97, "price"] = np.nan
    got = pd.concat([part for first in range(0, 2000, 300) for part in I._book(("a",), iter([rows[first : first + 300]]), state)])
    book = {}
    for r, found in zip(rows.itertuples(), got.itertuples(), strict=True):
        if r.size > 0:
            book[r.side, r.price] = r.size
        else:
            book.pop((r.side, r.price), None)
        bids, asks = ([p for s, p in book if s == side and p == p] for side in ("bid", "ask"))
        expected = (max(bids, default=None), min(asks, default=None), len(bids), len(asks))
        assert [None if v != v else v for v in (found.best_bid, found.best_ask, found.n_bids, found.n_asks)] == list(expected)


def test_an_update_does_not_read_all_levels():
    began = time.perf_counter()
    assert sum(len(part) for part in I._book(("a",), iter([updates(30_000, 10_000)]), Held())) == 30_000
    assert time.perf_counter() - began < 3
