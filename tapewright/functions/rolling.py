"""Windows over one symbol's rows in time order: rolling, running, lagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapewright.functions.staging import checkpointed


def series(key: str = "symbol", order: str = "ts") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def __getattr__(name: str):
    """W: one symbol's rows in time order. RUN: those up to the current one. Made on use, since a window needs a session."""
    if name == "W":
        return series()
    if name == "RUN":
        return series().rowsBetween(Window.unboundedPreceding, 0)
    raise AttributeError(name)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def roll(agg, x, n: int, least: int | None = None, w: WindowSpec | None = None) -> Column:
    """agg over the last n rows; null until `least` (default n) values are there, as pandas' rolling."""
    frame = (w or series()).rowsBetween(-(n - 1), 0)
    x = _c(x)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), agg(x).over(frame))


def mean(x, n, **k):
    return roll(F.avg, x, n, **k)


def std(x, n, **k):
    return roll(F.stddev_samp, x, n, **k)


def total(x, n, **k):
    return roll(F.sum, x, n, **k)


def highest(x, n, **k):
    return roll(F.max, x, n, **k)


def lowest(x, n, **k):
    return roll(F.min, x, n, **k)


def lag(x, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(_c(x), k).over(w or series())


def lead(x, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lead(_c(x), k).over(w or series())


def running(agg, x, w: WindowSpec | None = None) -> Column:
    return agg(_c(x)).over((w or series()).rowsBetween(Window.unboundedPreceding, 0))


def change(x, k: int = 1, w: WindowSpec | None = None) -> Column:
    return _c(x) - lag(x, k, w)


def ratio(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))


def quotient(a, b) -> Column:
    """a / b as IEEE 754 has it, and DuckDB's `/`: a number over 0 is infinite, 0 over 0 is NaN. `ratio` gives null for both."""
    a, b = _c(a), _c(b)
    return F.coalesce(F.try_divide(a, b), F.when(b == 0, a * F.pow(b, F.lit(-1.0))))


def log(x) -> Column:
    """Natural logarithm as IEEE 754 has it: that of 0 is minus infinity, that of less is NaN. `F.ln` gives null for both."""
    x = _c(x)
    return F.when(x > 0, F.ln(x)).when(x == 0, float("-inf")).when(x < 0, float("nan"))


def sign(x) -> Column:
    """-1, 0 or 1; 0 for NaN, as in DuckDB."""
    x = _c(x)
    return F.when(F.isnan(x), 0.0).otherwise(F.signum(x))


def rounded(x, digits: int) -> Column:
    """x to `digits` decimals as DuckDB's `round` has it: x * 10 ** digits to the next whole number, halves away from zero, and divided again; x itself where that is no number.

    `F.round` goes by the shortest decimal that names x, which near a half can lie on the other side.
    """
    x, scale = _c(x), F.lit(10.0**digits)
    out = F.round(x * scale) / scale  # a half is exact in binary, so here the shortest decimal does no harm
    return F.when(F.abs(out) < float("inf"), out).otherwise(x)


def step_return(x, k: int = 1, w: WindowSpec | None = None) -> Column:
    """`pct`, but infinite, or NaN, after a price of 0."""
    return quotient(x, lag(x, k, w)) - 1


def given(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in the columns; `dropna` would drop NaN as well."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def pct(x, k: int = 1, w: WindowSpec | None = None) -> Column:
    return ratio(x, lag(x, k, w)) - 1


def zscore(x, n: int, eps: float = 0.0, w: WindowSpec | None = None) -> Column:
    return ratio(_c(x) - mean(x, n, w=w), std(x, n, w=w) + eps)


def average_rank(x, *by: str) -> Column:
    """Rank among the rows with equal `by`, ties averaged; null for null."""
    x = _c(x)
    w = Window.partitionBy(*by)
    return F.when(x.isNotNull(), F.rank().over(w.orderBy(x.asc_nulls_last())) + (F.count(x).over(w.partitionBy(*by, x)) - 1) / 2)


def true_range() -> Column:
    prev = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def islands(flag_or_value, w: WindowSpec | None = None) -> Column:
    """Number of the run of equal values that a row is in, from 0."""
    x, w = _c(flag_or_value), w or series()
    new = F.when(~x.eqNullSafe(F.lag(x).over(w)), 1).otherwise(0)
    return F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1


def order_bucket(x) -> Column:
    """A number that never falls as x grows, of which 8,192 lie between a value and e times that value; infinities and, after all others, NaN have their own."""
    x = _c(x)
    far = F.when(F.abs(x) < float("inf"), F.floor(F.ln(F.abs(x)) * 8192).cast("long") + 10_000_000).otherwise(20_000_000)
    return F.when(F.isnan(x), 30_000_000).when(x == 0, 0).when(x > 0, far).otherwise(-far)


def value_places(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """(by, x, n, before): each distinct value with its rows and the rows of smaller values, among those with equal `by`.

    Equal values are counted first, so a value that many rows share is one row here. Values are summed up
    within buckets of near values, on top of the buckets before, whose number depends on the range of
    values and not on the rows. The counts are written once, so ranks of several columns don't multiply a plan.
    """
    values = checkpointed(df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n")).withColumn("_bucket", order_bucket(x)))
    sums = values.groupBy(*by, "_bucket").agg(F.sum("n").alias("_s"))
    past = Window.unboundedPreceding, -1
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.partitionBy(*(by or [F.lit(1)])).orderBy("_bucket").rowsBetween(*past)), F.lit(0)))
    sums = sums.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_bucket").alias("_of"), "_before")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "_bucket").orderBy(x).rowsBetween(*past)), F.lit(0))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    out = values.withColumn("_inside", inside).join(sums, [*same, F.col("_bucket") == F.col("_of")])
    return out.select(*by, x, "n", (F.col("_before") + F.col("_inside")).alias("before"))


def spread_rank(df: DataFrame, x: str, by: list[str], name: str) -> DataFrame:
    """Adds the rank of x among the rows with equal `by`, ties averaged, null for null: ranks of the distinct values, joined back."""
    places = value_places(df, x, by)
    places = places.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col(x).alias("_x"), (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    return df.join(places, [*same, F.col(x) == F.col("_x")], "left").drop("_x", *[f"_of_{c}" for c in by])


def percentiles(df: DataFrame, x: str, shares: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """(by, q): exact percentiles of x, between neighbours in proportion, without a group in one task."""
    by = by or []
    places = value_places(df, x, by)
    total = places.groupBy(*by).agg(F.sum("n").alias("_n")).select(*[F.col(c).alias(f"_of_{c}") for c in by], "_n")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    j = places.join(total, same) if by else places.crossJoin(F.broadcast(total))  # one row
    at = [F.lit(s) * (F.col("_n") - 1) for s in shares]
    holds = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("n"))
    low = [F.max(F.when(holds(F.floor(a)), F.col(x))) for a in at]
    high = [F.max(F.when(holds(F.ceil(a)), F.col(x))) for a in at]
    part = [F.max(a - F.floor(a)) for a in at]
    return j.groupBy(*by).agg(F.array(*[a + (b - a) * c for a, b, c in zip(low, high, part, strict=True)]).alias("q"))
