"""Point in time: index memberships, actions known by a date, as-of panels and checks against looking ahead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import rolling as R


def members(spells: DataFrame, dates: DataFrame) -> DataFrame:
    """(index, symbol, d) for every date d inside one of the closed spells (index, symbol, start, end); an open end is null.

    Spells are dealt to the months that they touch, so that dates meet only spells of their month.
    """
    month = lambda c: F.date_trunc("month", c)
    last = dates.agg(F.max("d").alias("last"))
    s = spells.crossJoin(F.broadcast(last)).withColumn("until", F.coalesce("end", "last")).where("start <= until")  # one row
    s = s.withColumn("m", F.explode(F.sequence(month("start"), month("until"), F.expr("interval 1 month"))))
    d = dates.select("d", month("d").alias("m"))
    return s.join(d, "m").where((F.col("d") >= F.col("start")) & (F.col("d") <= F.col("until"))).select("index", "symbol", "d").distinct()


def membership_changes(spells: DataFrame, first, last) -> DataFrame:
    """(index, symbol, d, change): spells that start (added) or end (removed) between the dates."""
    at = lambda c, said: spells.where(F.col(c).between(first, last)).select("index", "symbol", F.col(c).alias("d"), F.lit(said).alias("change"))
    return at("start", "added").union(at("end", "removed"))


def known_actions(actions: DataFrame, as_of) -> DataFrame:
    """Actions announced by the date; those without an announcement drop out."""
    return actions.where(F.col("announced") <= as_of)


def known_adjusted(bars: DataFrame, actions: DataFrame, as_of) -> DataFrame:
    """Bars before or at as_of, adjusted by the actions with an ex-time up to as_of.

    A split divides earlier prices and multiplies earlier volumes by its ratio; a dividend takes its
    share of the first close at or after its ex-time off earlier prices. Factors are summed as logs
    from each symbol's end over the union of bars and actions: one sort, no range join.
    """
    b = bars.where(F.col("ts") <= as_of)
    a = actions.where(F.col("ex_ts") <= as_of).select("symbol", F.col("ex_ts").alias("ts"), "kind", "ratio", "amount", F.lit(0).alias("side"))
    both = b.withColumn("side", F.lit(1)).unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy("symbol")
    close_on = F.first("close", ignorenulls=True).over(w.orderBy("ts", "side").rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("close_on", close_on)
    cut = F.when(F.col("kind") == "split", -F.ln("ratio")).when((F.col("kind") == "dividend") & (F.col("close_on") > F.col("amount")), F.ln((F.col("close_on") - F.col("amount")) / F.col("close_on")))
    grow = F.when(F.col("kind") == "split", F.ln("ratio"))
    after = w.orderBy(F.desc("ts"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"log_price": F.coalesce(F.sum(cut).over(after), F.lit(0.0)), "log_volume": F.coalesce(F.sum(grow).over(after), F.lit(0.0))})
    return both.where("side = 1").drop("kind", "ratio", "amount", "side", "close_on").withColumns({"adj_close": F.col("close") * F.exp("log_price"), "adj_volume": F.col("volume") * F.exp("log_volume")})


def adjustment_log(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Per action: how many bars of its symbol lie before its ex-time. Counted by one sort of the union."""
    both = bars.select("symbol", "ts", F.lit(1).alias("bar")).unionByName(actions.select("symbol", F.col("ex_ts").alias("ts"), F.lit(0).alias("bar"), "kind", "seq"), allowMissingColumns=True)
    before = Window.partitionBy("symbol").orderBy("ts", "bar").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("n_bars", F.coalesce(F.sum("bar").over(before), F.lit(0))).where("bar = 0").select("symbol", F.col("ts").alias("ex_ts"), "kind", "seq", "n_bars")


def look_ahead(df: DataFrame, as_of, key: str = "symbol") -> DataFrame:
    """Per key: the latest time, and whether any row is later than as_of."""
    late = F.sum(F.when(F.col("ts") > as_of, 1).otherwise(0))
    return df.groupBy(key).agg(F.max("ts").alias("last_ts"), late.alias("n_late")).withColumn("clean", F.when(F.col("n_late") == 0, 1).otherwise(0))


def as_of_series(bars: DataFrame, ends: DataFrame) -> DataFrame:
    """For each end time the last bar of every symbol at or before it. ends: (end).

    Every bar holds until the next one, so ends and bars meet by the day on which an end lies.
    """
    nxt = F.lead("ts").over(R.W)
    last = ends.agg(F.max("end").alias("last"))
    spans = bars.withColumn("until", nxt).crossJoin(F.broadcast(last)).withColumn("until", F.coalesce(F.col("until") - F.expr("interval 1 microsecond"), "last"))  # one row
    spans = spans.where("ts <= last").withColumn("day", F.explode(F.sequence(F.to_date("ts"), F.to_date(F.greatest("ts", F.least("until", "last"))))))
    e = ends.withColumn("day", F.to_date("end"))
    return spans.join(e, "day").where("end >= ts and end <= until").select("end", "symbol", F.col("ts").alias("bar_ts"), "close")


def aligned(*frames: DataFrame, on: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Rows whose keys all frames have."""
    return reduce(lambda a, b: a.join(b, list(on)), frames)


def feature_target(df: DataFrame, features: list[str], ahead: int) -> DataFrame:
    """Features with the return over the next `ahead` rows, where all are known."""
    target = F.try_divide(F.lead("close", ahead).over(R.W), "close") - 1
    return df.withColumn("target", target).dropna(subset=[*features, "target"])


def execution_market(fills: DataFrame, bars: DataFrame) -> DataFrame:
    """Fills with their symbol's deviation of returns, mean volume and last close; one row per symbol is joined."""
    r = bars.withColumn("r", R.pct("close"))
    stats = r.groupBy("symbol").agg(F.stddev_samp("r").alias("sigma"), F.avg("volume").alias("adv"), F.max_by("close", "ts").alias("last_close"), F.count(F.lit(1)).alias("n_bars"))
    return fills.join(stats, "symbol", "left")
