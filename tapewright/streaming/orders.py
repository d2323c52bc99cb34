"""An order-by-order book kept as streaming state."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapewright.streaming.incremental import GIVEN_ROWS, timed_events


class Side:
    """Sizes by price, and the best price from a heap from which empty levels are taken only when they come up."""

    def __init__(self, sign: int):
        self.sign = sign  # -1: the highest price is best
        self.levels: dict[float, list] = {}  # price: size, orders
        self.heap: list[float] = []

    def add(self, price: float, size: float, orders: int) -> None:
        level = self.levels.get(price)
        if level is None:
            level = self.levels[price] = [0.0, 0]
            heapq.heappush(self.heap, self.sign * price)
        level[0] += size
        level[1] += orders
        if not level[1]:
            del self.levels[price]

    def best(self) -> tuple[float, float]:
        while self.heap and self.sign * self.heap[0] not in self.levels:
            heapq.heappop(self.heap)
        if not self.heap:
            return math.nan, math.nan
        price = self.sign * self.heap[0]
        return price, self.levels[price][0]


class Book:
    """Orders by id, and both sides' levels; an update costs the logarithm of the levels."""

    def __init__(self, orders: dict[int, tuple[bool, float, float]] | None = None):
        self.orders = orders or {}
        self.sides = {True: Side(-1), False: Side(1)}
        for bid, price, size in self.orders.values():
            self.sides[bid].add(price, size, 1)

    def update(self, order: int, action: str, bid: bool, price: float, size: float) -> tuple:
        """add and modify put the order where it is said to be, delete takes it away; what isn't there isn't deleted."""
        old = self.orders.pop(order, None)
        if old:
            self.sides[old[0]].add(old[1], -old[2], -1)
        if action != "delete":
            self.orders[order] = (bid, price, size)
            self.sides[bid].add(price, size, 1)
        (b, nb), (a, na) = self.sides[True].best(), self.sides[False].best()
        return len(self.orders), b, a, nb, na


SCHEMA = "symbol string, ts timestamp, seq long, n_orders long, best_bid double, best_ask double, bid_size double, ask_size double"
STATE = "ids array<long>, bids array<boolean>, prices array<double>, sizes array<double>"


def _each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else ([], [], [], [])
    book = Book({i: (bool(b), p, s) for i, b, p, s in zip(*held, strict=True)})
    rows = pd.concat(list(frames)).sort_values(["ts", "seq"])  # a micro-batch of one symbol: its size is set by the source's files per trigger
    for first in range(0, len(rows), GIVEN_ROWS):
        part = rows.iloc[first : first + GIVEN_ROWS]
        columns = (part[c] for c in ("ts", "seq", "order_id", "action", "side", "price", "size"))
        out = [(key[0], t, n, *book.update(o, a, side == "bid", p, float(s))) for t, n, o, a, side, p, s in zip(*columns, strict=True)]
        yield pd.DataFrame(out, columns=["symbol", "ts", "seq", "n_orders", "best_bid", "best_ask", "bid_size", "ask_size"])
    own = list(book.orders.values())
    state.update((list(book.orders), [o[0] for o in own], [o[1] for o in own], [o[2] for o in own]))


def order_book(orders: DataFrame) -> DataFrame:
    """orders: (symbol, ts, seq, order_id, action, side, price, size), in time order from micro-batch to micro-batch.

    After every update: the orders that stand, best prices and the sizes there. The state is the orders.
    """
    return orders.groupBy("symbol").applyInPandasWithState(_each, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)


def order_ticks(spark: SparkSession, sf_dir: str, files: int = 6) -> DataFrame:
    """A stream of order events in micro-batches that follow one another in time, at least `files` of them.

    Each user has one order a symbol, even users buy and odd ones sell; sizes that 4 divides take it away.
    """
    e = timed_events(spark, sf_dir, least=files)
    size = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("user_id").alias("order_id"),
        F.when(size % 4 == 0, "delete").otherwise("add").alias("action"), F.when(F.col("user_id") % 2 == 0, "bid").otherwise("ask").alias("side"), F.round("value", 1).alias("price"), size.alias("size"),
    )
