"""As-of and interval joins, point-in-time universes and adjustments, keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, value: str, key: str = "symbol", ttl_seconds: int | None = None, order: str = "ts") -> DataFrame:
    """left with `value` of the last right row at or before each time; older than the TTL counts as missing.

    Union, one sort by (key, time), last value carried: no join, so no blow-up on hot keys beyond the
    sort itself. At equal times right rows come first.
    """
    right = right.select(F.col(key), F.col(order), F.struct(F.col(order).alias("t"), F.col(value).alias("v")).alias("_v"), F.lit(0).alias("_side"))
    both = left.withColumn("_side", F.lit(1)).unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    age = F.unix_timestamp(order) - F.unix_timestamp("_last.t")
    found = F.col("_last.v") if ttl_seconds is None else F.when(age <= ttl_seconds, F.col("_last.v"))
    return out.withColumns({value: found, "age_seconds": age}).drop("_side", "_v", "_last")


def range_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, bucket: str = "day") -> DataFrame:
    """Rows of points inside [start, end] of spans with the same key: both sides dealt by (key, bucket), then filtered."""
    unit = {"day": 86400, "hour": 3600}[bucket]
    b = lambda c: F.floor(F.unix_timestamp(c) / unit)
    p = points.withColumn("_b", b(at))
    s = spans.withColumn("_b", F.explode(F.sequence(b(start), b(end))))
    return p.join(s, [key, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def active(dim: DataFrame, dates: DataFrame) -> DataFrame:
    """dim: (symbol, listing, delist, ...); dates: (d). Symbols listed at each date, delisting inclusive."""
    return dates.join(dim, (F.col("listing") <= F.col("d")) & (F.col("delist").isNull() | (F.col("d") <= F.col("delist"))))


def factors(actions: DataFrame) -> DataFrame:
    """Price and volume factors of corporate actions: (symbol, ex_ts, kind, ratio, amount, close_before)."""
    k = F.col("kind")
    price = F.when(k.isin("split", "stock_dividend"), 1 / F.col("ratio")).when(k == "reverse_split", F.col("ratio")).when(k == "dividend", F.try_divide(F.col("close_before") - F.col("amount"), F.col("close_before"))).otherwise(1.0)
    volume = F.when(k.isin("split", "stock_dividend"), F.col("ratio")).when(k == "reverse_split", 1 / F.col("ratio")).otherwise(1.0)
    return actions.withColumns({"price_factor": price, "volume_factor": volume})


def adjusted(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Backward adjustment: every bar times the product of the factors of all later actions of its symbol.

    Products from the end of each symbol over the union of bars and actions: one sort, no range join.
    """
    a = actions.select("symbol", F.col("ex_ts").alias("ts"), F.ln("price_factor").alias("_p"), F.ln("volume_factor").alias("_v"), F.lit(0).alias("_side"))
    both = bars.withColumn("_side", F.lit(1)).unionByName(a, allowMissingColumns=True)
    later = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"price_factor": F.exp(F.coalesce(F.sum("_p").over(later), F.lit(0.0))), "volume_factor": F.exp(F.coalesce(F.sum("_v").over(later), F.lit(0.0)))})
    return both.where("_side = 1").drop("_p", "_v", "_side").withColumns({"adj_close": F.col("close") * F.col("price_factor"), "adj_volume": F.col("volume") * F.col("volume_factor")})


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], first_wins: bool = True) -> DataFrame:
    """What the table holds after the write: conflicting rows of `new` are ignored, or replace the stored ones."""
    if first_wins:
        return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti"))
    return new.unionByName(stored.join(new.select(*keys), keys, "left_anti"))


def folds(df: DataFrame, n: int, purge: int = 0, embargo: int = 0, key: str = "symbol") -> DataFrame:
    """Purged k-fold: (row, fold, role). Contiguous tests; `purge` rows before and `embargo` rows after a test are in neither.

    Each row is exploded to n folds; the fold bounds follow from the row number and the series' length.
    """
    w = Window.partitionBy(key)
    d = df.withColumns({"row": F.row_number().over(w.orderBy("ts")) - 1, "_n": F.count(F.lit(1)).over(w)})
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    size = F.floor(F.col("_n") / n)
    start = F.col("fold") * size
    end = F.when(F.col("fold") == n - 1, F.col("_n")).otherwise(start + size)
    role = F.when((F.col("row") >= start) & (F.col("row") < end), "test").when((F.col("row") >= start - purge) & (F.col("row") < start), "none").when((F.col("row") >= end) & (F.col("row") < end + embargo), "none").otherwise("train")
    return d.withColumn("role", role).drop("_n")


def walk_forward(df: DataFrame, train: int, gap: int, test: int, step: int, expanding: bool = False, key: str = "symbol") -> DataFrame:
    """Rolling or expanding training windows, a gap, then a test window; rows outside have no role and are dropped."""
    w = Window.partitionBy(key)
    d = df.withColumns({"row": F.row_number().over(w.orderBy("ts")) - 1, "_n": F.count(F.lit(1)).over(w)})
    n_folds = F.floor((F.col("_n") - train - gap - test) / step) + 1
    d = d.where(n_folds > 0).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), n_folds - 1)))
    start = F.col("fold") * step
    end = start + train
    first = F.lit(0) if expanding else start
    role = F.when((F.col("row") >= first) & (F.col("row") < end), "train").when((F.col("row") >= end + gap) & (F.col("row") < end + gap + test), "test")
    return d.withColumn("role", role).where("role is not null").drop("_n")


def fold_audit(f: DataFrame, key: str = "symbol") -> DataFrame:
    """Sizes, gap between training and test, and whether training comes first."""
    tr, te = F.col("role") == "train", F.col("role") == "test"
    g = f.groupBy(key, "fold").agg(
        F.sum(F.when(tr, 1).otherwise(0)).alias("n_train"), F.sum(F.when(te, 1).otherwise(0)).alias("n_test"), F.max(F.when(tr, F.col("row"))).alias("last_train"), F.min(F.when(te, F.col("row"))).alias("first_test"),
    )
    return g.withColumns({"gap": F.col("first_test") - F.col("last_train") - 1, "ordered": F.when(F.col("last_train") < F.col("first_test"), 1).otherwise(0)})


def share_split(df: DataFrame, train: float = 0.7, validation: float = 0.15, key: str = "symbol") -> DataFrame:
    """Part of each row by its place in time within its series."""
    w = Window.partitionBy(key)
    at = (F.row_number().over(w.orderBy("ts")) - 1) / F.count(F.lit(1)).over(w)
    return df.withColumn("part", F.when(at < train, "train").when(at < train + validation, "validation").otherwise("test"))
