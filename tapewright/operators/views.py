"""Feature views: what was known of each feature at an entity's time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class FeatureView:
    """rows: (key, ts, features, and `created` if values become known later than they hold). A value older than ttl_seconds is missing."""

    name: str
    rows: DataFrame
    features: list[str]
    ttl_seconds: int | None = None
    created: str | None = None


def historical_features(entities: DataFrame, views: list[FeatureView], key: str = "symbol", order: str = "ts", slab_seconds: int = 86400) -> DataFrame:
    """entities with `view__feature` columns, and `view__age` in seconds: the newest value that held and was known at the entity's time.

    A value is known from the later of its own and its created time on; of values for one time, the one
    created last counts, so a late correction replaces the value that it corrects, but no newer one. All
    views and the entities are one union, sorted once inside slabs of time; what was known before a slab
    comes from a table of one row per key and slab, so a key with many rows lies in many tasks. Entities
    stay as often as they come; a null key meets values of the null key.
    """
    keyed = F.col(key)
    slab = F.floor(F.unix_seconds(order) / slab_seconds)
    known = None
    for k, v in enumerate(views):
        created = F.col(v.created) if v.created else F.col(order)
        value = F.struct(F.col(order).alias("t"), created.alias("c"), *[F.col(c) for c in v.features])
        rows = v.rows.select(keyed, F.greatest(order, created).alias(order), value.alias(f"_v{k}"))
        known = rows if known is None else known.unionByName(rows, allowMissingColumns=True)
    names = [f"_v{k}" for k in range(len(views))]
    known = known.withColumn("_slab", slab)
    ends = known.groupBy(keyed, "_slab").agg(*[F.max(c).alias(c) for c in names])
    entity_slabs = entities.select(keyed, slab.alias("_slab")).distinct()
    ends = ends.unionByName(entity_slabs, allowMissingColumns=True).groupBy(keyed, "_slab").agg(*[F.max(c).alias(c) for c in names])
    before = Window.partitionBy(key).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("_key"), F.col("_slab").alias("_of"), *[F.max(c).over(before).alias(f"_c{c}") for c in names])
    both = entities.withColumns({"_slab": slab, "_side": F.lit(1)}).unionByName(known.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(key, "_slab").orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({c: F.max(c).over(inside) for c in names}).where("_side = 1")
    out = out.join(carried, keyed.eqNullSafe(F.col("_key")) & (F.col("_slab") == F.col("_of")), "left")
    for c, v in zip(names, views, strict=True):
        last = F.greatest(F.col(c), F.col(f"_c{c}"))
        age = F.unix_seconds(order) - F.unix_seconds(last["t"])
        fresh = F.lit(True) if v.ttl_seconds is None else age <= v.ttl_seconds
        out = out.withColumns({**{f"{v.name}__{f}": F.when(fresh, last[f]) for f in v.features}, f"{v.name}__age": F.when(fresh, age)})
    return out.drop("_slab", "_side", "_key", "_of", *names, *[f"_c{c}" for c in names])


def materialised(view: FeatureView, path: str, key: str = "symbol", order: str = "ts") -> FeatureView:
    """The view written by day to `path`, days that come anew replacing the stored ones, and read from there."""
    spark = view.rows.sparkSession
    columns = [key, order, *([view.created] if view.created else []), *view.features]
    days = view.rows.select(*columns).withColumn("day", F.to_date(order))
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return FeatureView(view.name, spark.read.parquet(path).drop("day"), view.features, view.ttl_seconds, view.created)
