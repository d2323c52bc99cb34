"""Structured Streaming: watermarked rollups, keyed feature state, incremental order books."""

from __future__ import annotations

import bisect
import math
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Schema of the event stream.
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder in a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")).rstrip("/")


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ticks(spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parquet*"))


def _ticks(e: DataFrame) -> DataFrame:
    size = F.get_json_object("props", "$.k").cast("long").alias("size")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), size)


#: Rows in a micro-batch of a stream that follows time.
TRIGGER_ROWS = 1_000_000


def timed_files(spark: SparkSession, sf_dir: str, rows: int = TRIGGER_ROWS, least: int = 1) -> str:
    """A folder with the events in files of about `rows` rows that follow one another in time, `least` files at least.

    Events are dealt by range of (ts, event_id) into one folder for each file, then copied file after file,
    since a stream takes files in the order of their making. So a micro-batch of one file doesn't grow with the table.
    """
    path = f"{shared_dir(spark)}/timed-{uuid.uuid4().hex}"
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    parts = max(least, math.ceil(events.count() / rows), 1)
    events.repartitionByRange(parts, "ts", "event_id").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{path}/dealt")
    dealt = spark.read.schema(f"{EVENTS}, part int").parquet(f"{path}/dealt")
    empty = spark.createDataFrame([], EVENTS)
    empty.write.parquet(f"{path}/files")  # a stream of no events needs a folder too
    for (part,) in sorted(dealt.select("part").distinct().collect()):  # one row per file
        dealt.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/files")
    empty.write.mode("overwrite").parquet(f"{path}/dealt")
    return f"{path}/files"


def timed_events(spark: SparkSession, sf_dir: str, rows: int = TRIGGER_ROWS, least: int = 1) -> DataFrame:
    """The stream of those files, one in a micro-batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(timed_files(spark, sf_dir, rows, least))


def timed_tick_stream(spark: SparkSession, sf_dir: str, rows: int = TRIGGER_ROWS) -> DataFrame:
    """`tick_stream` in time order, for state that a row's successors read."""
    return _ticks(timed_events(spark, sf_dir, rows))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there, into a table of the shared folder, and reads that table."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def drained_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs an aggregate without a watermark over all that is there; each micro-batch rewrites the table of its current rows."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def rollup_stream(ticks: DataFrame, every: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Bars that can't change any more: later rows than the watermark are dropped, open windows are held back."""
    order = F.struct("ts", "seq")
    g = ticks.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "symbol").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count"),
    )
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trade_count")


def sessions(ticks: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    g = ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
    return g.select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("end_ts"), "n", "total")


class Features:
    """Incremental features of one symbol; the state is a flat tuple of numbers and the last `window` prices."""

    COLUMNS = ("ema_12", "ema_26", "macd", "rsi_14", "mean_20", "sd_20", "low_20", "high_20", "pct_b")

    def __init__(self, state: tuple | None = None, window: int = 20, n: int = 14):
        self.window, self.n = window, n
        self.k, self.last, self.fast, self.slow, self.gain, self.loss, self.prices = state or (0, 0.0, 0.0, 0.0, 0.0, 0.0, [])

    def state(self) -> tuple:
        return (self.k, self.last, self.fast, self.slow, self.gain, self.loss, self.prices)

    def update(self, x: float) -> tuple:
        first = self.k == 0
        self.fast = x if first else self.fast + 2 / 13 * (x - self.fast)
        self.slow = x if first else self.slow + 2 / 27 * (x - self.slow)
        if not first:  # a running mean for the first n changes, then Wilder's smoothing
            m = min(self.k, self.n)
            d = x - self.last
            self.gain += (max(d, 0.0) - self.gain) / m
            self.loss += (max(-d, 0.0) - self.loss) / m
        self.k, self.last = self.k + 1, x
        self.prices = [*self.prices, x][-self.window :]
        rsi = 50.0 if first else 100.0 if self.loss == 0 else 100 - 100 / (1 + self.gain / self.loss)
        p = self.prices
        mean = sum(p) / len(p)
        sd = math.sqrt(sum((v - mean) ** 2 for v in p) / (len(p) - 1)) if len(p) > 1 else 0.0
        pct_b = (x - mean + 2 * sd) / (4 * sd) if sd > 0 else 0.5
        return (self.fast, self.slow, self.fast - self.slow, rsi, mean, sd, min(p), max(p), pct_b)


FEATURE_SCHEMA = "symbol string, ts timestamp, seq long, " + ", ".join(f"{c} double" for c in Features.COLUMNS)
STATE_SCHEMA = "k long, last double, fast double, slow double, gain double, loss double, prices array<double>"


#: Rows that are given out at a time.
GIVEN_ROWS = 10_000


def _ordered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One micro-batch of one symbol in time order, in parts; its size is set by the source's files per trigger."""
    rows = pd.concat([f.drop(columns="symbol", errors="ignore") for f in frames]).sort_values(["ts", "seq"])
    for first in range(0, len(rows), GIVEN_ROWS):
        yield rows.iloc[first : first + GIVEN_ROWS]


def _features(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    f = Features(tuple(state.get) if state.exists else None)
    f.prices = list(f.prices)
    for rows in _ordered(frames):
        out = [(key[0], t, s, *f.update(x)) for t, s, x in zip(rows["ts"], rows["seq"], rows["price"])]
        yield pd.DataFrame(out, columns=["symbol", "ts", "seq", *Features.COLUMNS])
    state.update(f.state())


def feature_stream(ticks: DataFrame) -> DataFrame:
    """A feature row per tick, from state kept per symbol; ticks in time order from micro-batch to micro-batch (`timed_tick_stream`)."""
    return ticks.select("symbol", "ts", "seq", "price").groupBy("symbol").applyInPandasWithState(_features, FEATURE_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def feature_batch(ticks: DataFrame) -> DataFrame:
    """The same features in batch, through the same code."""
    from tapewright.functions.ordered import fold

    def step(s, seq, price):
        f = s or Features()
        return f, (seq, *f.update(price))

    return fold(ticks, ["seq", "price"], step, {"seq": "long", **{c: "double" for c in Features.COLUMNS}}, order="ts", then=("seq",))


def _book(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    prices, sizes = state.get if state.exists else ([], [])
    book = dict(zip(prices, sizes))
    bids, asks = sorted(k for k in book if k < 0), sorted(k for k in book if k >= 0)  # an update searches one of them; none is read through
    for rows in _ordered(frames):
        out = []
        for t, s, side, p, q in zip(rows["ts"], rows["seq"], rows["side"], rows["price"], rows["size"]):
            at = -1 - p if side == "bid" else p  # bids are kept under negative numbers: one map for both sides
            levels = bids if at < 0 else asks
            if q > 0:
                if at not in book and at == at:
                    bisect.insort(levels, at)
                book[at] = q
            elif book.pop(at, None) is not None and at == at:
                del levels[bisect.bisect_left(levels, at)]
            out.append((key[0], t, s, -1 - bids[0] if bids else None, asks[0] if asks else None, len(bids), len(asks)))
        yield pd.DataFrame(out, columns=["symbol", "ts", "seq", "best_bid", "best_ask", "n_bids", "n_asks"])
    state.update((list(book), list(book.values())))


def book_stream(updates: DataFrame) -> DataFrame:
    """updates: (symbol, ts, seq, side, price, size). Best prices after every update, from a book kept as state."""
    schema = "symbol string, ts timestamp, seq long, best_bid double, best_ask double, n_bids long, n_asks long"
    return updates.groupBy("symbol").applyInPandasWithState(_book, schema, "prices array<double>, sizes array<double>", "append", GroupStateTimeout.NoTimeout)
