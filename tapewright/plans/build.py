"""Turns operators on bars into queries: rounded columns beside symbol and epoch seconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.sources.tables import bars, seconds


def rounded(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("symbol", "ts"), digits: int = 6) -> DataFrame:
    """keys (ts as epoch seconds) and the columns as doubles rounded to `digits` as in the SQL; -0.0 becomes 0.0."""
    out = [seconds() if k == "ts" else F.col(k) for k in keys]
    return df.select(*out, *[(R.rounded(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in columns])


def on_bars(operator: Callable[[DataFrame], DataFrame], *columns: str) -> Callable:
    """The query that applies an operator to the 15-minute bars and returns the named columns."""

    def query(spark, sf_dir):
        return rounded(operator(bars(spark, sf_dir)), *columns)

    return query
