"""Roll-ups that late rows still correct, and a monitor of drift that keeps sketches as its state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.streaming.incremental import EVENTS, shared_dir

_FIRST_LAST = ("ts", "seq", "price")


def replayed_ticks(spark: SparkSession, sf_dir: str, files: int = 8, per_batch: int = 1) -> DataFrame:
    """A stream of the ticks in `files` files, each with rows of all times, so that most rows come late; `per_batch` files make a micro-batch."""
    path = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    events.repartition(files, F.col("event_id") % files).write.parquet(path)
    e = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).parquet(path)
    size = F.get_json_object("props", "$.k").cast("long").alias("size")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), size)


def partial_bars(ticks: DataFrame, every: str) -> DataFrame:
    """Bars in a form that can be merged: the first and last trade whole, besides sums and extremes."""
    trade = F.struct(*_FIRST_LAST)
    g = ticks.groupBy("symbol", F.window("ts", every).alias("_w")).agg(
        F.min(trade).alias("first"), F.max(trade).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count"),
    )
    return g.select("symbol", F.col("_w.start").alias("ts"), F.col("_w.end").alias("end_ts"), "first", "last", "high", "low", "volume", "trade_count")


def merged_bars(parts: DataFrame) -> DataFrame:
    """Whole bars of all parts, with `late_count`, the trades that came after their bar was given out."""
    g = parts.groupBy("symbol", "ts").agg(
        F.min("first").alias("_f"), F.max("last").alias("_l"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"),
        F.sum("trade_count").alias("trade_count"), F.sum(F.when(F.col("late"), F.col("trade_count")).otherwise(0)).alias("late_count"),
    )
    return g.select("symbol", "ts", F.col("_f.price").alias("open"), "high", "low", F.col("_l.price").alias("close"), "volume", "trade_count", "late_count")


def corrected_rollup(ticks: DataFrame, path: str, every: str = "15 minutes", late: str = "1 hour"):
    """Starts the roll-up of a stream into `path`; bars(path) reads it.

    Each micro-batch writes the parts of the bars it has rows of under its own number, so a batch that is
    run again replaces what it wrote. A part is late if its bar ended before the newest time of all earlier
    batches less `late`: that bar had been given out, and the part corrects it. No row is dropped, and no
    state is kept but one time per batch.
    """
    spark = ticks.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        marks = spark.read.schema("newest timestamp, batch long").parquet(f"{path}/marks").where(F.col("batch") < number) if number else spark.createDataFrame([], "newest timestamp, batch long")
        mark = marks.agg((F.max("newest") - F.expr(f"interval {late}")).alias("mark"))  # one row
        parts = partial_bars(batch, every).crossJoin(F.broadcast(mark)).withColumn("late", F.coalesce(F.col("end_ts") <= F.col("mark"), F.lit(False))).drop("mark")
        parts.write.mode("overwrite").parquet(f"{path}/parts/batch={number}")
        batch.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def corrected_bars(spark: SparkSession, path: str) -> DataFrame:
    return merged_bars(spark.read.parquet(f"{path}/parts"))


def compacted(spark: SparkSession, path: str, to: str) -> DataFrame:
    """The parts of all batches so far merged into one part per bar, written to `to`; they merge with later parts as any part does."""
    g = spark.read.parquet(f"{path}/parts").groupBy("symbol", "ts", "end_ts", "late").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"),
    )
    g.write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


#: Quantiles of each distribution that are compared.
POINTS = 200


def sketches(rows: DataFrame, by: str, x: str, k: int) -> DataFrame:
    """(by, n, sketch): quantile sketches of x of bounded size; works on streams too, where the sketch is the state."""
    return rows.where(F.col(x).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))


def drift(current: DataFrame, baseline: DataFrame, by: str, warning: float = 0.1, critical: float = 0.2) -> DataFrame:
    """(by, n, ks, alert) of two tables of sketches: the largest gap of the two distributions at the baseline's quantiles.

    Both are known by POINTS quantiles, so ks is right to 1 / POINTS, besides the sketches' own error.
    """
    shares = F.array(*[F.lit((i + 0.5) / POINTS) for i in range(POINTS)])
    quantiles = F.kll_sketch_get_quantile_double("sketch", shares)
    base = baseline.select(by, quantiles.alias("_b"))
    j = current.withColumn("_c", quantiles).join(base, by)
    upto = lambda values, q: F.size(F.filter(values, lambda v: v <= q)) / POINTS
    j = j.withColumn("ks", F.array_max(F.transform("_b", lambda q: F.abs(upto(F.col("_c"), q) - upto(F.col("_b"), q)))))
    return j.select(by, "n", "ks", F.when(F.col("ks") > critical, "critical").when(F.col("ks") > warning, "warning").otherwise("ok").alias("alert"))


def drift_monitor(stream: DataFrame, baseline: DataFrame, by: str, x: str, path: str, k: int = 4096):
    """Starts a monitor of x on a stream; after each micro-batch the drift of all rows so far is written under its number.

    The state is one sketch of at most k values a key and level, so it doesn't grow with the rows. Ranks
    are right to about 2.3 / k ** 0.9, and exact for up to k rows.
    """
    base = sketches(baseline, by, x, k)

    def each(batch: DataFrame, number: int) -> None:
        drift(batch, base, by).write.mode("overwrite").parquet(f"{path}/alerts/batch={number}")

    return sketches(stream, by, x, k).writeStream.foreachBatch(each).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def latest_drift(spark: SparkSession, path: str) -> DataFrame:
    """The drift after the last micro-batch."""
    rows = spark.read.parquet(f"{path}/alerts")
    last = rows.agg(F.max("batch").alias("_last"))  # one row
    return rows.join(F.broadcast(last), F.col("batch") == F.col("_last")).drop("batch", "_last")
