"""Queries of quotes and depth columns (survey 2.8.37 to 2.8.47 and 2.11) and their SQL.

Each tick stands for a quote of three levels a side around its price; sizes follow from its number, some are 0.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.operators import book as B
from tapewright.operators import depth as D
from tapewright.operators import microstructure as M
from tapewright.plans.build import rounded
from tapewright.plans.oracle import TICKS, lag, roll, wide
from tapewright.plans.records import BK, _updates
from tapewright.sources.tables import bars, ticks

QUERIES: dict = {}
ORACLES: dict = {}
KEY = ("symbol", "seq")
LEVELS = 3


def depth_table(s, d):
    """(symbol, ts, seq, price, side, bid_price_1, bid_size_1, ask_price_1, ...)."""
    t, seq = ticks(s, d), F.col("seq")
    columns = {"side": F.when(seq % 2 == 0, 1.0).otherwise(-1.0)}
    for i in range(1, LEVELS + 1):
        columns |= {
            f"bid_price_{i}": F.col("price") - i * (1 + seq % 3) / 4, f"ask_price_{i}": F.col("price") + i * (1 + seq % 4) / 4,
            f"bid_size_{i}": F.when((seq + i) % 7 == 0, 0.0).otherwise((F.col("size") + i * (seq % 5)).cast("double")), f"ask_size_{i}": F.when((seq + i) % 6 == 0, 0.0).otherwise((F.col("size") + i * (seq % 8)).cast("double")),
        }
    return t.withColumns(columns)


def quotes(s, d):
    t = depth_table(s, d)
    return t.select("symbol", "ts", "seq", "price", "side", *[F.col(f"{b}_{what}_1").alias(name) for b, what, name in (("bid", "price", "bid"), ("bid", "size", "bid_size"), ("ask", "price", "ask"), ("ask", "size", "ask_size"))])


_L = ", ".join(
    f"price - {i} * (1 + seq % 3) / 4 AS bp{i}, price + {i} * (1 + seq % 4) / 4 AS ap{i}, CASE WHEN (seq + {i}) % 7 = 0 THEN 0.0 ELSE size + {i} * (seq % 5) END::DOUBLE AS bs{i}, CASE WHEN (seq + {i}) % 6 = 0 THEN 0.0 ELSE size + {i} * (seq % 8) END::DOUBLE AS as{i}"
    for i in range(1, LEVELS + 1)
)
_LIST = lambda c: "list_filter([" + ", ".join(f"{{'p': {c}p{i}, 's': {c}s{i}}}" for i in range(1, LEVELS + 1)) + "], lambda x: x.p IS NOT NULL AND x.s > 0)"
WO = "PARTITION BY symbol ORDER BY ts, seq"
DEPTH = [
    TICKS, f"dt AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 1.0 ELSE -1.0 END AS side, {_L} FROM ticks)", "qt AS (SELECT *, (bp1 + ap1) / 2 AS mid, CASE WHEN bs1 + as1 = 0 THEN (bp1 + ap1) / 2 ELSE (bp1 * as1 + ap1 * bs1) / (bs1 + as1) END AS wm FROM dt)",
    f"bk AS (SELECT *, {_LIST('b')} AS b, {_LIST('a')} AS a FROM dt)", "bm AS (SELECT *, (b[1].p + a[1].p) / 2 AS m FROM bk)",
]
SUM = lambda side, k: f"coalesce(list_sum(list_transform({side}[1:{k}], lambda x: x.s)), 0)"
DW = lambda side: f"list_sum(list_transform({side}, lambda x: x.s / (1 + abs(x.p - m) / m * 100)))"
IMB = lambda k: f"coalesce(({SUM('b', k)} - {SUM('a', k)}) / nullif({SUM('b', k)} + {SUM('a', k)}, 0), 0)"
DISTANCE = f"CASE WHEN len(b) = 0 OR len(a) = 0 THEN 0 ELSE coalesce(({DW('b')} - {DW('a')}) / nullif({DW('b')} + {DW('a')}, 0), 0) END"


def sql(columns: dict[str, str], source: str, where: str = "") -> str:
    chosen = ", ".join(f"round({e}, 6) AS {n}" for n, e in columns.items())
    return "WITH " + ",\n".join(DEPTH) + f"\nSELECT symbol, seq, {chosen} FROM {source} {where}"


def add(name, make, columns, source="qt", where=""):
    QUERIES[name] = lambda s, d: rounded(make(s, d), *columns, keys=KEY)
    ORACLES[name] = sql(columns, source, where)


def fields(s, d):
    return D.quote_fields(quotes(s, d))


def books(s, d):
    return B.quotes_to_levels(depth_table(s, d))


add("q_2_8_37_level_1_imbalance", fields, {"imbalance": "coalesce((bs1 - as1) / nullif(bs1 + as1, 0), 0)"})
add("q_2_8_38_weighted_mid", fields, {"weighted_mid": "wm"})
add("q_2_8_39_mid_divergence", fields, {"divergence": "wm - mid"})
QUALITY = {"effective_spread": "2 * abs(price - mid) * side", "adverse_selection": f"(lead(mid, 5) OVER ({WO}) - mid) * side"}
for _name, _column in (("q_2_8_41_effective_spread", "effective_spread"), ("q_2_8_43_adverse_selection", "adverse_selection")):
    add(_name, lambda s, d: D.trade_quality(fields(s, d)), {_column: QUALITY[_column]})
add("q_2_11_19_crossed_book", fields, {"crossed": "CASE WHEN bp1 >= ap1 THEN 1.0 ELSE 0.0 END"})
add("q_2_11_17_quote_to_book", lambda s, d: fields(s, d).where("bid_size > 0 and ask_size > 0"), {"bid": "bp1", "bid_size": "bs1", "ask": "ap1", "ask_size": "as1", "mid": "mid"}, where="WHERE bs1 > 0 AND as1 > 0")
SIZES = {"n_bids": "len(b)::DOUBLE", "n_asks": "len(a)::DOUBLE", "best_bid": "b[1].p", "best_ask": "a[1].p", "last_bid": "b[len(b)].p"}
_counted = lambda s, d: books(s, d).withColumns({"n_bids": F.size("bids"), "n_asks": F.size("asks"), "best_bid": F.get("bids", F.lit(0))["price"], "best_ask": F.get("asks", F.lit(0))["price"], "last_bid": F.try_element_at("bids", F.when(F.size("bids") > 0, -1).otherwise(1))["price"]})
add("q_2_11_6_depth_arrays", _counted, SIZES, "bk")
add("q_2_11_18_depth_rows_to_book", lambda s, d: _counted(s, d).withColumns({"bid_depth": B.depth(F.col("bids")), "ask_depth": B.depth(F.col("asks"))}), {"best_bid": "b[1].p", "best_ask": "a[1].p", "bid_depth": SUM("b", 3), "ask_depth": SUM("a", 3)}, "bk")
LOB = {"imbalance_1": IMB(1), "imbalance_3": IMB(3), "imbalance_distance": DISTANCE}
_filled = lambda s, d: books(s, d).where((F.size("bids") > 0) & (F.size("asks") > 0))
FILLED = "WHERE len(b) > 0 AND len(a) > 0"
add("q_2_11_28_snapshot_imbalances", lambda s, d: D.imbalances(_filled(s, d)), LOB | {"imbalance_5": IMB(5), "imbalance_10": IMB(10)}, "bm", FILLED)
add(
    "q_2_8_46_depth_features", lambda s, d: D.imbalances(_filled(s, d)).withColumns({"mid": (F.col("bids")[0]["price"] + F.col("asks")[0]["price"]) / 2, "spread_bps": R.quotient(F.col("asks")[0]["price"] - F.col("bids")[0]["price"], (F.col("bids")[0]["price"] + F.col("asks")[0]["price"]) / 2) * 1e4}),
    LOB | {"mid": "m", "spread_bps": "(a[1].p - b[1].p) / m * 10000"}, "bm", FILLED,
)
D5 = lambda side: SUM(side, 5)
RECORD = {
    "mid": "m", "spread_bps": "(a[1].p - b[1].p) / m * 10000", "relative_spread": "(a[1].p - b[1].p) / m", "bid_depth_1": "b[1].s", "ask_depth_1": "a[1].s", "bid_depth_5": D5("b"), "ask_depth_5": D5("a"), "total_depth": f"{D5('b')} + {D5('a')}", "depth_imbalance": IMB(5),
    **{f"{n}_impact_{q}": f"coalesce({q}.0 / nullif({D5(o)}, 0), 0) * (a[1].p - b[1].p) / m * 10000" for q in (100, 1000) for n, o in (("buy", "a"), ("sell", "b"))},
}
for _name in ("q_2_11_12_book_record", "q_2_11_27_snapshot_features"):
    add(_name, lambda s, d: D.record(books(s, d)), RECORD if "record" in _name else {c: RECORD[c] for c in ("mid", "spread_bps", "total_depth", "depth_imbalance")}, "bm", FILLED)
_series = lambda s, d: D.dynamics(D.record(books(s, d)).withColumns({"book_imbalance": F.col("depth_imbalance"), "pressure": D.pressure_imbalance(F.col("bids"), F.col("asks"))}))
PRESS = lambda side: f"list_sum(list_transform({side}[1:5], lambda x, i: x.s * greatest(0, exp(-0.5 * (i - 1)) * (1 - abs(x.p - m) / m))))"
DEPTH += [
    f"dr AS (SELECT symbol, ts, seq, m AS mid, (a[1].p - b[1].p) / m * 10000 AS sb, {IMB(5)} AS im, {D5('b')} + {D5('a')} AS td, coalesce(({PRESS('b')} - {PRESS('a')}) / nullif({PRESS('b')} + {PRESS('a')}, 0), 0) AS pr FROM bm {FILLED})",
    f"dy AS (SELECT *, {roll('avg(im)', 10, w=WO)} AS ma, round({roll('stddev_samp(im)', 10, w=WO)}, 12) AS sd FROM dr)",
]
_lag = lambda c: lag(c, w=WO)
MOVES = {
    "mid_change": f"mid - {_lag('mid')}", "mid_return": f"mid / nullif({_lag('mid')}, 0) - 1", "spread_change": f"sb - {_lag('sb')}", "imbalance_change": f"im - {_lag('im')}", "imbalance_ma": "ma", "imbalance_std": "sd",
    "depth_change": f"td - {_lag('td')}", "depth_ma": roll("avg(td)", 10, w=WO), "pressure_change": f"pr - {_lag('pr')}", "imbalance_momentum": "(im - ma) / CASE WHEN sd = 0 THEN 1 ELSE sd END",
}
QUERIES["q_2_8_47_imbalance_dynamics"] = lambda s, d: rounded(_series(s, d), *MOVES, keys=KEY)
ORACLES["q_2_8_47_imbalance_dynamics"] = sql(MOVES, "dy")
PROXY = {"proxy_bid": "(high + low) / 2 - (high - low) / 4", "proxy_ask": "(high + low) / 2 + (high - low) / 4", "proxy_spread_bps": "(high - low) / 2 / nullif(close, 0) * 10000", "proxy_imbalance": "(coalesce((close - low) / nullif(high - low, 0), 0.5) - 0.5) * 2"}
QUERIES["q_2_8_45_bar_proxies"] = lambda s, d: rounded(D.bar_proxies(M.toxicity(bars(s, d))), *PROXY)
ORACLES["q_2_8_45_bar_proxies"] = wide(PROXY)

# Books from level updates.
TOP = "SELECT symbol, side, k::BIGINT AS level, round(price, 6) AS price, round(size, 6) AS size FROM tp WHERE k <= 3"


def _top(s, d):
    b = B.snapshots(_updates(s, d), 3)
    sides = [b.select("symbol", F.lit(n).alias("side"), F.posexplode(c).alias("k", "x")) for n, c in (("bid", "bids"), ("ask", "asks"))]
    return rounded(sides[0].union(sides[1]).select("symbol", "side", (F.col("k") + 1).cast("bigint").alias("level"), "x.price", "x.size"), "price", "size", keys=("symbol", "side", "level"))


QUERIES["q_2_11_16_top_levels"], ORACLES["q_2_11_16_top_levels"] = _top, BK + TOP
FILL = {"buy_vwap": "CASE WHEN fl >= 100 THEN co / fl END", "buy_impact_bps": "CASE WHEN fl >= 100 THEN (co / fl - mid) / mid * 10000 END"}


def _fills(s, d):
    b = B.snapshots(_updates(s, d)).where((F.size("bids") > 0) & (F.size("asks") > 0))
    mid = (F.col("bids")[0]["price"] + F.col("asks")[0]["price"]) / 2
    b = b.withColumns({"buy_vwap": D.fill_price(F.col("asks"), 100), "mid": mid})
    return rounded(b.withColumn("buy_impact_bps", (F.col("buy_vwap") - F.col("mid")) / F.col("mid") * 1e4), *FILL, keys=("symbol",))


QUERIES["q_2_11_22_vwap_to_quantity"] = _fills
ORACLES["q_2_11_22_vwap_to_quantity"] = BK + "SELECT symbol, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in FILL.items()) + " FROM al"
