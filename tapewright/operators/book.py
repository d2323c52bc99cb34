"""Order books as arrays of (price, size), the audit chain, and pre-trade rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL = "struct<price:double,size:double>"


def snapshots(updates: DataFrame, levels: int = 10) -> DataFrame:
    """updates: (symbol, ts, seq, side, price, size). The book at each symbol's last update: the latest size of
    every price, without those of 0, best prices first. Levels of one book meet by groupBy; a book is small."""
    last = updates.groupBy("symbol", "side", "price").agg(F.max_by("size", F.struct("ts", "seq")).alias("size"), F.max("ts").alias("ts"))
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    k = F.row_number().over(Window.partitionBy("symbol", "side").orderBy(best))
    top = last.where("size > 0").withColumn("k", k).where(F.col("k") <= levels)
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("k", "price", "size")))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))
    return top.groupBy("symbol").agg(side("bid").alias("bids"), side("ask").alias("asks"))


def depth(levels: Column, k: int | None = None) -> Column:
    """Total size of the first k levels (all without k)."""
    return F.aggregate(levels if k is None else F.slice(levels, 1, k), F.lit(0.0), lambda a, x: a + x["size"])


def imbalance(bids: Column, asks: Column, k: int) -> Column:
    b, a = depth(bids, k), depth(asks, k)
    return F.coalesce(F.try_divide(b - a, b + a), F.lit(0.0))


def weighted_depth(levels: Column, weight) -> Column:
    """Sum of size * weight(level number from 0, price)."""
    return F.aggregate(F.transform(levels, lambda x, i: x["size"] * weight(i, x["price"])), F.lit(0.0), lambda a, x: a + x)


def weighted_price(levels: Column) -> Column:
    w = F.transform(levels, lambda x, i: x["size"] / (i + 1))
    top = F.aggregate(F.zip_with(levels, w, lambda x, k: x["price"] * k), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(top, F.aggregate(w, F.lit(0.0), lambda a, x: a + x))


def sweep(levels: Column, quantity: Column) -> Column:
    """struct(filled, cost): what a market order of `quantity` takes from the levels in turn."""
    start = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("cost"))

    def take(a, x):
        q = F.least(x["size"], quantity - a["filled"])
        return F.struct((a["filled"] + q).alias("filled"), (a["cost"] + q * x["price"]).alias("cost"))

    return F.aggregate(levels, start, take)


def measures(books: DataFrame) -> DataFrame:
    b, a = F.col("bids"), F.col("asks")
    bp, ap, bs, as_ = b[0]["price"], a[0]["price"], b[0]["size"], a[0]["size"]
    mid = (bp + ap) / 2
    near = lambda i, p: F.exp(-0.5 * i) * F.greatest(F.lit(0.0), 1 - F.abs(p - mid) / mid)
    pb, pa = weighted_depth(b, near), weighted_depth(a, near)
    lb, la = weighted_depth(b, lambda i, p: 1 / (i + 1)), weighted_depth(a, lambda i, p: 1 / (i + 1))
    s = sweep(a, F.lit(100.0))
    avg = F.try_divide(s["cost"], s["filled"])
    return books.where((F.size("bids") > 0) & (F.size("asks") > 0)).withColumns(
        {
            "mid": mid, "spread": ap - bp, "spread_bps": F.try_divide(ap - bp, mid) * 1e4, "microprice": F.try_divide(bp * as_ + ap * bs, bs + as_), "imbalance_1": imbalance(b, a, 1), "imbalance_5": imbalance(b, a, 5),
            "imbalance_weighted": F.coalesce(F.try_divide(lb - la, lb + la), F.lit(0.0)), "pressure": F.coalesce(F.try_divide(pb - pa, pb + pa), F.lit(0.0)), "weighted_mid": (weighted_price(b) + weighted_price(a)) / 2,
            "bid_depth": depth(b), "ask_depth": depth(a), "sweep_filled": s["filled"], "sweep_price": avg, "impact_bps": F.when(s["filled"] >= 100, F.try_divide(avg - mid, mid) * 1e4), "crossed": F.when(bp >= ap, 1).otherwise(0),
        }
    )


def quotes_to_levels(df: DataFrame) -> DataFrame:
    """Wide level columns (bid_price_1, bid_size_1, ...) to arrays without the missing ones."""
    side = lambda s, n: F.filter(F.array(*[F.struct(F.col(f"{s}_price_{i}").alias("price"), F.col(f"{s}_size_{i}").alias("size")) for i in range(1, n + 1)]), lambda x: x["price"].isNotNull() & (x["size"] > 0))
    n = sum(c.startswith("bid_price_") for c in df.columns)
    return df.withColumns({"bids": side("bid", n), "asks": side("ask", n)})


def chained(events: DataFrame, fields: list[str], key: str, order: str) -> DataFrame:
    """Each row's hash of its own fields, and the hash of the row before it in its chain; the first has GENESIS."""
    own = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in fields]), 256)
    e = events.withColumn("event_hash", own)
    return e.withColumn("previous_hash", F.coalesce(F.lag("event_hash").over(Window.partitionBy(key).orderBy(order)), F.lit("GENESIS")))


def verify_chain(events: DataFrame, fields: list[str], key: str, order: str) -> DataFrame:
    """Per chain: rows, rows whose hash or link is wrong, and the first of them."""
    again = chained(events.withColumnsRenamed({"event_hash": "_h", "previous_hash": "_p"}), fields, key, order)
    w = Window.partitionBy(key).orderBy(order)
    bad = (F.col("_h") != F.col("event_hash")) | (F.col("_p") != F.coalesce(F.lag("_h").over(w), F.lit("GENESIS")))
    again = again.withColumn("_bad", F.coalesce(bad, F.lit(True)))
    return again.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_bad"), 1).otherwise(0)).alias("n_bad"), F.min(F.when(F.col("_bad"), F.col(order))).alias("first_bad"))


def pretrade(orders: DataFrame, limits: dict) -> DataFrame:
    """orders: (order_id, ts, account, symbol, sector, value, position, adv, portfolio). Verdict by rules in order.

    Running counts and turnover are windows over the account's day; all other rules are projections.
    """
    day = Window.partitionBy("account", F.to_date("ts")).orderBy("ts", "order_id")
    o = orders.withColumns({"n_today": F.row_number().over(day), "turnover_today": F.sum("value").over(day.rowsBetween(Window.unboundedPreceding, 0))})
    v = F.col("value")
    weight = F.try_divide(F.col("position") + v, F.col("portfolio"))
    rules = [
        ("daily_count", F.col("n_today") > limits["daily"], "REJECTED"), ("min_size", v < limits["least"], "REJECTED"), ("liquidity", v > limits["adv_share"] * F.col("adv"), "REJECTED"),
        ("max_size", v > limits["most"], "REDUCED"), ("concentration", weight > limits["position"], "REDUCED"),
    ]
    rule, verdict = F.lit("none"), F.lit("PASSED")
    for name, cond, said in reversed(rules):
        rule, verdict = F.when(cond, name).otherwise(rule), F.when(cond, said).otherwise(verdict)
    return o.withColumns({"rule": rule, "verdict": verdict, "weight_after": weight})
