"""Queries of readers, layouts and resampling (survey 2.1 and 2.4.1 to 2.4.2): tables are written out and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapewright.plans.build import rounded
from tapewright.plans.oracle import TICKS, over_bars
from tapewright.sources import layouts as L
from tapewright.sources.tables import bars, seconds, standardised, table, ticks
from tapewright.streaming.incremental import shared_dir

QUERIES: dict = {}
ORACLES: dict = {}
E = lambda c="ts": f"CAST(epoch({c}) AS BIGINT)"
OHLC = ("open", "high", "low", "close")
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in OHLC)
BARS = f"SELECT symbol, {E()} AS ts, {ROUNDED}, volume FROM bars"


def add(name, make, sql):
    QUERIES[name] = make
    ORACLES[name] = sql


def place(s, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _core(s, d):
    return bars(s, d).select("symbol", "ts", *OHLC, "volume")


def _written(s, d, form: str) -> str:
    return L.write_named(_core(s, d), place(s, f"bars-{form}"), form)


def _out(df, *more):
    return rounded(df, *OHLC, keys=("symbol", "ts", "volume", *more))


add("q_2_1_1_discovered_symbols", lambda s, d: L.discovered(s, _written(s, d, "csv"), "csv"), over_bars("SELECT DISTINCT symbol FROM bars"))
add("q_2_1_3_parquet_bars", lambda s, d: _out(L.load(s, _written(s, d, "parquet"), "parquet")), over_bars(BARS))
add("q_2_1_5_many_symbols", lambda s, d: _out(L.load(s, _written(s, d, "csv"), "csv", ["click", "view", "nosuch"])), over_bars(BARS + " WHERE symbol IN ('click', 'view')"))
add("q_2_1_6_long_union", lambda s, d: _out(L.load(s, _written(s, d, "csv"), "csv").orderBy("ts", "symbol")), over_bars(BARS))
add("q_2_1_10_parquet_columns", lambda s, d: rounded(L.load(s, _written(s, d, "parquet"), "parquet", columns=["close"]), "close"), over_bars(f"SELECT symbol, {E()} AS ts, round(close, 6) AS close FROM bars"))
add("q_2_11_25_symbol_of_file", lambda s, d: L.load(s, _written(s, d, "csv"), "csv").groupBy(F.upper("symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("n")), over_bars("SELECT upper(symbol) AS symbol, count(*) AS n FROM bars GROUP BY 1"))


def _with_bad_rows(s, d):
    """CSV text of the bars with names in capitals; every row whose volume is a multiple of 10 is spoilt."""
    path = place(s, "bad")
    line = F.concat_ws(",", "symbol", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), *[F.col(c).cast("string") for c in OHLC], "volume")
    _core(s, d).select(F.when(F.col("volume") % 10 == 0, "spoilt,row").otherwise(line)).write.text(path)
    read = s.read.schema("SYMBOL string, TIMESTAMP timestamp, OPEN double, HIGH double, LOW double, CLOSE double, VOLUME long").option("mode", "DROPMALFORMED").csv(path)
    return standardised(read).where("ts is not null")


add("q_2_1_9_csv_scan", lambda s, d: _out(_with_bad_rows(s, d)), over_bars(BARS + " WHERE volume % 10 <> 0"))


def _diagonal(s, d):
    a, b = place(s, "left"), place(s, "right")
    _core(s, d).where("symbol = 'click'").select("symbol", "ts", "close").write.parquet(a)
    _core(s, d).where("symbol <> 'click'").select("symbol", "ts", "close", "volume").write.parquet(b)
    return rounded(L.all_columns(s, a, b), "close", "volume")


add("q_2_1_11_diagonal_load", _diagonal, over_bars(f"SELECT symbol, {E()} AS ts, round(close, 6) AS close, CASE WHEN symbol <> 'click' THEN volume::DOUBLE END AS volume FROM bars"))
add(
    "q_2_1_13_standard_times", lambda s, d: standardised(ticks(s, d).select(F.col("symbol").alias("Symbol"), F.col("seq").alias("SEQ"), F.when(F.col("seq") % 9 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Time"))).select("symbol", "seq", F.unix_timestamp("ts").cast("double").alias("ts")),
    f"WITH {TICKS} SELECT symbol, seq, CASE WHEN seq % 9 <> 0 THEN floor(epoch(ts)) END AS ts FROM ticks",
)
add(
    "q_2_1_14_schema_warnings", lambda s, d: rounded(L.schema_warnings(_core(s, d).withColumns({"open": F.when(F.col("volume") % 4 != 0, F.col("open")), "close": F.col("close").cast("string")}).drop("volume", "high")), "pct", keys=("column", "problem")),
    over_bars("SELECT 'open' AS \"column\", 'nulls' AS problem, round(avg(CASE WHEN volume % 4 = 0 THEN 100.0 ELSE 0 END), 6) AS pct FROM bars UNION ALL SELECT 'high', 'missing', NULL UNION ALL SELECT 'volume', 'missing', NULL UNION ALL SELECT 'close', 'type', NULL"),
)


def _tick_table(s, d):
    """Ticks in two batches, the second appended."""
    path, t = place(s, "ticks"), ticks(s, d)
    for half in (0, 1):
        L.write_ticks(t.where(F.col("seq") % 2 == half), path)
    return s.read.schema(f"{t.schema.simpleString()[7:-1].replace(':', ' ')}, date date").parquet(path)


BY_DAY = "SELECT {d} AS day, count(*) AS n, round(sum(price), 4) AS total FROM ticks GROUP BY 1"
add("q_2_1_15_tick_table", lambda s, d: _tick_table(s, d).groupBy(F.unix_timestamp(F.col("date").cast("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("total")), f"WITH {TICKS} " + BY_DAY.format(d=E("CAST(ts AS DATE)")))
add("q_2_1_23_inserted_ticks", lambda s, d: _tick_table(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq")), f"WITH {TICKS} SELECT symbol, count(*) AS n, max(seq) AS last_seq FROM ticks GROUP BY 1")
add("q_2_1_27_tick_range", lambda s, d: rounded(_tick_table(s, d).where("date = '2024-01-03' and ts >= '2024-01-03 06:00:00' and ts < '2024-01-03 18:00:00'"), "price", keys=("symbol", "seq")), f"WITH {TICKS} SELECT symbol, seq, round(price, 6) AS price FROM ticks WHERE ts >= TIMESTAMP '2024-01-03 06:00:00' AND ts < TIMESTAMP '2024-01-03 18:00:00'")


def _bar_table(s, d):
    path = place(s, "store")
    for timeframe, every in (("15m", "15 minutes"), ("1h", "1 hour")):
        L.write_bars(bars(s, d, every).select("symbol", "ts", *OHLC, "volume", "vwap", "trade_count"), path, timeframe)
    return s.read.parquet(path)


def _frames(select: str) -> str:
    return over_bars(select, "hb AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, last(price ORDER BY ts, seq) AS close, count(*) AS trade_count FROM ticks GROUP BY 1, 2)", "st AS (SELECT '15m' AS timeframe, symbol, ts, close, trade_count FROM bars UNION ALL SELECT '1h', symbol, ts, close, trade_count FROM hb)")


add(
    "q_2_1_16_bar_table", lambda s, d: _bar_table(s, d).groupBy("timeframe", F.unix_timestamp(F.col("week").cast("timestamp")).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.sum("trade_count").alias("trades"), F.round(F.sum("close"), 4).alias("total")),
    _frames(f"SELECT timeframe, {E('date_trunc(chr(119), ts)').replace('chr(119)', chr(39) + 'week' + chr(39))} AS week, count(*) AS n, CAST(sum(trade_count) AS BIGINT) AS trades, round(sum(close), 4) AS total FROM st GROUP BY 1, 2"),
)
add("q_2_1_42_bar_rows", lambda s, d: rounded(_bar_table(s, d).withColumn("volume", F.col("volume").cast("double")), "close", keys=("timeframe", "symbol", "ts", "trade_count")), _frames(f"SELECT timeframe, symbol, {E()} AS ts, trade_count, round(close, 6) AS close FROM st"))
add(
    "q_2_1_17_dimensions", lambda s, d: ticks(s, d).join(table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("c_custkey")), "seq").join(table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("sector")), "c_custkey").groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("total")),
    "SELECT c_mktsegment AS sector, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN customer ON user_id = c_custkey GROUP BY 1",
)


def _migrated(s, d):
    path, b = place(s, "csv"), _core(s, d)
    b = b.withColumn("volume", F.when(F.col("volume") % 3 != 0, F.col("volume"))).withColumnRenamed("ts", "Date")
    b.union(b.where("minute(Date) = 0")).write.option("header", True).csv(path)
    store = place(s, "store")
    read = s.read.schema("symbol string, Date timestamp, open double, high double, low double, close double, volume long").option("header", True).csv(path)
    L.migrated(read).withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(store)
    return _out(s.read.parquet(store))


add("q_2_1_30_migration", _migrated, over_bars(BARS.replace(", volume FROM", ", CASE WHEN volume % 3 <> 0 THEN volume ELSE 0 END AS volume FROM")))
SECTOR = "CASE symbol " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.SECTORS.items()) + " ELSE 'unknown' END"
add("q_2_1_33_sectors", lambda s, d: L.with_sector(ticks(s, d)).groupBy("symbol", "sector").agg(F.count(F.lit(1)).alias("n")), f"WITH {TICKS} SELECT symbol, {SECTOR} AS sector, count(*) AS n FROM ticks GROUP BY 1, 2")
add(
    "q_2_1_43_universe_metadata", lambda s, d: L.with_sector(L.load(s, _written(s, d, "parquet"), "parquet")).groupBy("symbol", "sector").agg(F.count(F.lit(1)).alias("n_bars"), F.unix_timestamp(F.min("ts")).alias("first_ts"), F.unix_timestamp(F.max("ts")).alias("last_ts")),
    over_bars(f"SELECT symbol, {SECTOR} AS sector, count(*) AS n_bars, {E('min(ts)')} AS first_ts, {E('max(ts)')} AS last_ts FROM bars GROUP BY 1, 2"),
)


def _action_file(s, d):
    path, t = place(s, "actions"), ticks(s, d).where("seq % 10 = 0")
    kind = F.when(F.col("seq") % 20 == 0, "split").otherwise("dividend")
    t.select("symbol", kind.alias("kind"), F.col("ts").alias("ex_date"), (F.col("ts") - F.expr("interval 3 days")).alias("announced"), F.when(kind == "split", F.lit(2.0)).alias("ratio"), F.when(kind == "dividend", F.col("price") / 100).alias("amount")).write.option("header", True).csv(path)
    return L.read_actions(s, path)


add(
    "q_2_1_40_action_file", lambda s, d: _action_file(s, d).groupBy("symbol", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ratio"), 4).alias("ratio"), F.round(F.sum("amount"), 4).alias("amount")),
    f"WITH {TICKS} SELECT symbol, CASE WHEN seq % 20 = 0 THEN 'split' ELSE 'dividend' END AS kind, count(*) AS n, round(sum(CASE WHEN seq % 20 = 0 THEN 2.0 ELSE 1 END)::DOUBLE, 4) AS ratio, round(sum(CASE WHEN seq % 20 = 0 THEN 0 ELSE price / 100 END), 4) AS amount FROM ticks WHERE seq % 10 = 0 GROUP BY 1, 2",
)


# Longer time frames.
def _resampled_sql(every: str) -> str:
    return f"SELECT symbol, time_bucket(INTERVAL {every}, ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, last(trade_count ORDER BY ts) AS trade_count FROM bars GROUP BY 1, 2"


add("q_2_4_1_resampled", lambda s, d: rounded(L.resampled(bars(s, d), "1 hour"), *OHLC, keys=("symbol", "ts", "volume", "trade_count")), over_bars(f"SELECT symbol, {E()} AS ts, {ROUNDED}, volume, trade_count FROM x", f"x AS ({_resampled_sql('1 HOUR')})"))
FRAMES = {"30m": ("30 minutes", "30 MINUTE"), "1h": ("1 hour", "1 HOUR"), "4h": ("4 hours", "4 HOUR"), "1d": ("1 day", "1 DAY")}


def _all_frames(s, d):
    b, out = bars(s, d), None
    for name, (every, _) in FRAMES.items():
        one = L.resampled(b, every).withColumn("timeframe", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, *OHLC, keys=("timeframe", "symbol", "ts", "volume"))


add("q_2_4_2_all_time_frames", _all_frames, over_bars(f"SELECT timeframe, symbol, {E()} AS ts, {ROUNDED}, volume FROM x", "x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS timeframe, * FROM ({_resampled_sql(q)})" for n, (_, q) in FRAMES.items()) + ")"))
