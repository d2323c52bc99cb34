"""Tables of the market model, read from Parquet: ticks, bars and what stands for the dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; timestamps without zone become timestamps (UTC session zone)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, seq, price, size): one row per trade; seq breaks ties of ts."""
    e = table(spark, sf_dir, "events")
    size = F.get_json_object("props", "$.k").cast("long").alias("size")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), size)


def user_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with a wide universe: a symbol per user."""
    e = table(spark, sf_dir, "events")
    size = F.get_json_object("props", "$.k").cast("long").alias("size")
    return e.select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), size)


def rollup(trades: DataFrame, every: str) -> DataFrame:
    """OHLCV bars of `every` (such as '15 minutes'): one shuffle on (symbol, bucket), combined before it."""
    first_last = F.struct("ts", "seq")
    return (
        trades.groupBy("symbol", F.window("ts", every).alias("w"))
        .agg(
            F.min_by("price", first_last).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", first_last).alias("close"), F.sum("size").alias("volume"),
            F.try_divide(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vwap"), F.count(F.lit(1)).alias("trade_count"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "vwap", "trade_count")
    )


def bars(spark: SparkSession, sf_dir: str, every: str = "15 minutes") -> DataFrame:
    return rollup(ticks(spark, sf_dir), every)


def daily_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the wide universe."""
    return rollup(user_ticks(spark, sf_dir), "1 day")


def seconds(c: str = "ts") -> Column:
    """Epoch seconds, the form in which results carry times."""
    return F.unix_timestamp(c).alias(c)


TIME_COLUMNS = ("timestamp", "time", "datetime", "date")
BAR = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume long"


def standardised(df: DataFrame) -> DataFrame:
    """Lower-case names, and the first time column there is as `ts`; strings that are no time become null."""
    df = df.toDF(*[c.lower() for c in df.columns])
    name = next(c for c in TIME_COLUMNS if c in df.columns)
    kind = dict(df.dtypes)[name]
    return df.withColumn(name, F.try_to_timestamp(name) if kind == "string" else F.col(name).cast("timestamp")).withColumnRenamed(name, "ts")


def read_csv_bars(spark: SparkSession, path: str, schema: str = BAR) -> DataFrame:
    """Bars from CSV with a header; rows that don't fit the schema are dropped."""
    return standardised(spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path))


def symbol_of_file(column: str = "_metadata.file_path") -> Column:
    """Symbol from a file's name: what stands before the first underscore, in capitals."""
    return F.upper(F.split_part(F.element_at(F.split(column, "/"), -1), F.lit("_"), F.lit(1)))


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Rows of a SQL query of another database; the driver's jar must be on Spark's class path."""
    return standardised(spark.read.format("jdbc").options(url=url, query=query, **options).load())
