"""Depth of books in wide columns: quotes, imbalances, spreads and what trades do to them, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.operators import book as B


def share(a, b) -> Column:
    """(a - b) / (a + b); 0 where there is nothing."""
    return F.coalesce(F.try_divide(a - b, a + b), F.lit(0.0))


def weighted_mid(bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    """Each price by the other side's size; the mid of an empty book."""
    return F.coalesce(F.try_divide(bid * ask_size + ask * bid_size, bid_size + ask_size), (bid + ask) / 2)


def quote_fields(df: DataFrame) -> DataFrame:
    """Best-level measures of (bid, bid_size, ask, ask_size)."""
    b, bs, a, as_ = (F.col(c) for c in ("bid", "bid_size", "ask", "ask_size"))
    mid, weighted = (b + a) / 2, weighted_mid(b, bs, a, as_)
    return df.withColumns({"mid": mid, "imbalance": share(bs, as_), "weighted_mid": weighted, "divergence": weighted - mid, "crossed": F.when(b >= a, 1.0).otherwise(0.0)})


def trade_quality(df: DataFrame, ahead: int = 5) -> DataFrame:
    """Effective spread of each trade at the quote's mid, and how the mid moved in its direction `ahead` quotes on."""
    w = R.series().orderBy("ts", "seq")
    after = F.lead("mid", ahead).over(w)
    return df.withColumns({"effective_spread": 2 * F.abs(F.col("price") - F.col("mid")) * F.col("side"), "adverse_selection": (after - F.col("mid")) * F.col("side")})


def distance_weighted(bids: Column, asks: Column) -> Column:
    """Imbalance of sizes weighted by 1 / (1 + distance from the mid in per cent); 0 if a side is empty."""
    mid = (bids[0]["price"] + asks[0]["price"]) / 2
    total = lambda levels: F.aggregate(levels, F.lit(0.0), lambda a, x: a + R.quotient(x["size"], 1 + R.quotient(F.abs(x["price"] - mid), mid) * 100))
    return F.when((F.size(bids) == 0) | (F.size(asks) == 0), 0.0).otherwise(share(total(bids), total(asks)))


def imbalances(books: DataFrame, levels: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Imbalance of the first levels, and the one weighted by distance."""
    b, a = F.col("bids"), F.col("asks")
    return books.withColumns({**{f"imbalance_{k}": B.imbalance(b, a, k) for k in levels}, "imbalance_distance": distance_weighted(b, a)})


def record(books: DataFrame) -> DataFrame:
    """A book's record: depths of 1 and 5 levels, spread, and the impact of 100 and 1000 as size / depth * spread."""
    b, a = F.col("bids"), F.col("asks")
    mid, spread = (b[0]["price"] + a[0]["price"]) / 2, a[0]["price"] - b[0]["price"]
    d = {"mid": mid, "spread_bps": R.quotient(spread, mid) * 1e4, "relative_spread": R.quotient(spread, mid), "bid_depth_1": b[0]["size"], "ask_depth_1": a[0]["size"], "bid_depth_5": B.depth(b, 5), "ask_depth_5": B.depth(a, 5)}
    books = books.where((F.size("bids") > 0) & (F.size("asks") > 0)).withColumns(d)
    share = lambda n, of: F.coalesce(F.try_divide(F.lit(float(n)), F.col(f"{of}_depth_5")), F.lit(0.0))
    impact = {f"{side}_impact_{n}": R.quotient(share(n, of) * spread, mid) * 1e4 for n in (100, 1000) for side, of in (("buy", "ask"), ("sell", "bid"))}
    return books.withColumns({"total_depth": F.col("bid_depth_5") + F.col("ask_depth_5"), "depth_imbalance": B.imbalance(b, a, 5), **impact})


def pressure_imbalance(bids: Column, asks: Column, levels: int = 5, fall: float = 0.5) -> Column:
    """(bid - ask) / (bid + ask) of the sizes weighted by exp(-fall * level) less the share of the distance from the middle; 0 for an empty book."""
    mid = (bids[0]["price"] + asks[0]["price"]) / 2
    weight = lambda i, p: F.greatest(F.lit(0.0), F.exp(-fall * i) * (1 - R.quotient(F.abs(p - mid), mid)))
    b, a = (B.weighted_depth(F.slice(side, 1, levels), weight) for side in (bids, asks))
    return F.coalesce(F.when(b + a > 0, F.try_divide(b - a, b + a)), F.lit(0.0))


def dynamics(df: DataFrame, n: int = 10) -> DataFrame:
    """Changes and rolling means of a series of book records: (symbol, ts, seq, mid, spread_bps, book_imbalance, pressure, total_depth)."""
    w = R.series().orderBy("ts", "seq")
    step = lambda c: F.col(c) - F.lag(c).over(w)
    ma, sd = R.roll(F.avg, "book_imbalance", n, w=w), R.roll(F.stddev_samp, "book_imbalance", n, w=w)
    df = df.withColumns({"mid_change": step("mid"), "mid_return": F.try_divide("mid", F.lag("mid").over(w)) - 1, "spread_change": step("spread_bps"), "imbalance_change": step("book_imbalance"), "pressure_change": step("pressure"), "imbalance_ma": ma, "imbalance_std": sd, "depth_change": step("total_depth"), "depth_ma": R.roll(F.avg, "total_depth", n, w=w)})
    df = df.withColumn("imbalance_std", R.rounded("imbalance_std", 12))
    return df.withColumn("imbalance_momentum", (F.col("book_imbalance") - F.col("imbalance_ma")) / F.when(F.col("imbalance_std") == 0, 1.0).otherwise(F.col("imbalance_std")))


def bar_proxies(df: DataFrame) -> DataFrame:
    """A bar as a quote: bid and ask at a quarter of the range from its ends, and where the close lies between the ends."""
    mid, half = (F.col("high") + F.col("low")) / 2, (F.col("high") - F.col("low")) / 4
    at = F.coalesce(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))
    return df.withColumns({"proxy_bid": mid - half, "proxy_ask": mid + half, "proxy_spread_bps": F.try_divide(2 * half, F.col("close")) * 1e4, "proxy_imbalance": (at - 0.5) * 2})


def fill_price(levels: Column, quantity: float) -> Column:
    """Mean price of `quantity` taken from the levels; null if they hold less."""
    taken = B.sweep(levels, F.lit(float(quantity)))
    return F.when(taken["filled"] >= quantity, taken["cost"] / taken["filled"])
