"""Files of market data: where they lie, how they are written, and what is made of them when read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.sources.tables import BAR, standardised

#: What a bar's columns must be: families of types that fit.
FAMILIES = {"ts": ("timestamp", "date"), "open": ("double", "float", "int", "bigint"), "high": ("double", "float", "int", "bigint"), "low": ("double", "float", "int", "bigint"), "close": ("double", "float", "int", "bigint"), "volume": ("double", "float", "int", "bigint")}
#: Sectors of well-known event names; all others are unknown.
SECTORS = {"purchase": "commerce", "signup": "growth", "view": "traffic", "click": "traffic"}


def symbol_of_path(path: str = "_metadata.file_path") -> Column:
    """Symbol from a path such as .../name=click_15min.csv/part-0.csv: what stands before the first underscore or the suffix."""
    return F.regexp_extract(path, r"([^/=]+?)(?:_15min)?\.(?:csv|parquet)(?:/|$)", 1)


def write_named(bars: DataFrame, base: str, form: str) -> str:
    """One folder per symbol, named after it: <base>/name=<symbol>_15min.<form>."""
    named = bars.withColumn("name", F.concat("symbol", F.lit(f"_15min.{form}"))).drop("symbol").withColumnRenamed("ts", "timestamp")
    named.write.partitionBy("name").option("header", True).format(form).save(base)
    return base


def discovered(spark: SparkSession, base: str, form: str) -> DataFrame:
    """The symbols that files under base are named after; hidden files and metadata aren't symbols."""
    found = spark.read.format(form).schema(BAR.replace("symbol string, ", "")).load(base).select(symbol_of_path().alias("symbol")).distinct()
    return found.where("symbol <> '' and symbol <> 'symbol_metadata' and not startswith(symbol, '.')").orderBy("symbol")


def load(spark: SparkSession, base: str, form: str, symbols: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Bars of all files, or of some symbols (those without a file are left out), as one long table: symbol, ts, columns."""
    read = spark.read.format(form).schema(BAR.replace("symbol string, ", "")).option("header", True).option("mode", "DROPMALFORMED").load(base)
    out = standardised(read.select("*", symbol_of_path().alias("symbol")).drop("name"))
    if symbols is not None:
        out = out.where(F.col("symbol").isin(symbols))
    return out.select("symbol", "ts", *(columns or ("open", "high", "low", "close", "volume"))).where("ts is not null")


def all_columns(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files of different columns as one table; what a file lacks is null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def schema_warnings(df: DataFrame) -> DataFrame:
    """(column, problem, pct): columns that are missing or of another kind, and the share of nulls in prices."""
    spark, kinds = df.sparkSession, dict(df.dtypes)
    said = [(c, "missing", None) for c in FAMILIES if c not in kinds] + [(c, "type", None) for c, fit in FAMILIES.items() if c in kinds and kinds[c] not in fit]
    prices = [c for c in ("open", "high", "low", "close") if c in kinds]
    nulls = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in prices]).unpivot([], prices, "column", "pct")
    return spark.createDataFrame(said, "column string, problem string, pct double").unionByName(nulls.where("pct > 0").select("column", F.lit("nulls").alias("problem"), "pct"))


def write_ticks(ticks: DataFrame, path: str) -> str:
    """Ticks by day; more batches are appended."""
    ticks.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)
    return path


def write_bars(bars: DataFrame, path: str, timeframe: str) -> str:
    """Bars by time frame and week."""
    bars.withColumns({"timeframe": F.lit(timeframe), "week": F.to_date(F.date_trunc("week", "ts"))}).write.mode("append").partitionBy("timeframe", "week").parquet(path)
    return path


def migrated(df: DataFrame) -> DataFrame:
    """Bars as the store takes them: lower-case names, volume 0 where there is none, one row per symbol and time."""
    df = standardised(df)
    volume = F.coalesce(F.col("volume"), F.lit(0)) if "volume" in df.columns else F.lit(0)
    return df.select("symbol", "ts", "open", "high", "low", "close", volume.cast("bigint").alias("volume")).dropDuplicates(["symbol", "ts"])


def with_sector(df: DataFrame, sectors: dict[str, str] = SECTORS) -> DataFrame:
    """df with the sector of its symbol, unknown where the map has none; the map is a handful of fixed values."""
    dim = df.sparkSession.createDataFrame(list(sectors.items()), "symbol string, sector string")
    return df.join(F.broadcast(dim), "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("unknown")))


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """Corporate actions from CSV: a missing ratio is 1, a missing amount 0."""
    df = spark.read.schema("symbol string, kind string, ex_date timestamp, announced timestamp, ratio double, amount double").option("header", True).csv(path)
    return df.withColumns({"ratio": F.coalesce("ratio", F.lit(1.0)), "amount": F.coalesce("amount", F.lit(0.0))})


def resampled(bars: DataFrame, every: str) -> DataFrame:
    """Bars of a longer time frame: first open, highest high, lowest low, last close and trade count, volume in all; empty spans are left out."""
    g = bars.groupBy("symbol", F.window("ts", every).alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.max_by("trade_count", "ts").alias("trade_count"),
    )
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trade_count").dropna()
