"""Named features: Column builders with dependencies, materialised level by level."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import rolling as R


@dataclass(frozen=True)
class Feature:
    """build() gives the column, which may use the columns of `needs`."""

    name: str
    build: Callable[[], Column]
    needs: tuple[str, ...] = ()
    lookback: int = 1
    version: int = 1
    tags: frozenset[str] = field(default_factory=frozenset)


class Registry:
    def __init__(self):
        self.features: dict[str, Feature] = {}

    def register(self, feature: Feature) -> Feature:
        old = self.features.get(feature.name)
        if old and old.version >= feature.version:
            raise ValueError(f"{feature.name} has version {old.version} already")
        self.features[feature.name] = feature
        return feature

    def levels(self, names: list[str]) -> list[list[Feature]]:
        """What to compute, each level from those before it."""
        done: dict[str, int] = {}

        def level(name: str, above: tuple[str, ...] = ()) -> int:
            if name in above:
                raise ValueError(f"{name} needs itself")
            if name not in done:
                done[name] = 1 + max((level(n, (*above, name)) for n in self.features[name].needs if n in self.features), default=-1)
            return done[name]

        for n in names:
            level(n)
        return [[self.features[n] for n in done if done[n] == k] for k in range(max(done.values(), default=-1) + 1)]

    def materialise(self, df: DataFrame, names: list[str]) -> DataFrame:
        """df with the features; one projection per level, which Spark puts over one sort."""
        columns = df.columns
        for fs in self.levels(names):
            df = df.withColumns({f.name: f.build() for f in fs})
        return df.select(*columns, *names)

    def view(self, df: DataFrame, names: list[str], keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
        return self.materialise(df, names).select(*keys, *names)


def standard() -> Registry:
    r = Registry()
    r.register(Feature("return_1", lambda: R.pct("close"), lookback=2))
    r.register(Feature("sma_20", lambda: R.mean("close", 20), lookback=20))
    r.register(Feature("close_to_sma", lambda: R.ratio("close", "sma_20"), ("sma_20",), 20))
    r.register(Feature("volatility_20", lambda: R.std("return_1", 20), ("return_1",), 21))
    r.register(Feature("volume_ratio", lambda: R.ratio("volume", R.mean("volume", 20)), lookback=20))
    r.register(Feature("risk_adjusted", lambda: F.try_divide("return_1", "volatility_20"), ("return_1", "volatility_20"), 21))
    return r
