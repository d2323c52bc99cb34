"""Mutual information of features and a target by nearest neighbours, dealt over cells of the plane.

The estimator is that of Kraskov, Stoegbauer and Grassberger: the distance to the k-th neighbour in the
plane, larger of both axes' differences, gives the width in which each axis' neighbours are counted.
Values are measured in standard deviations on a grid of 2 ** -30, so all comparisons are exact, and
equal points are one row with a weight, so a value that a third of all rows share is one row too.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.staging import checkpointed

GRID = 2**30
#: Bits of a value inside its bucket when values are counted along one axis.
BUCKET_BITS = 20
FAR = 2**62


def points(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, x, y, w): distinct points on the grid and how many rows are there; rows whose feature or target is null or not finite are left out of that feature.

    x and y are long. A feature or target that doesn't vary has 0 everywhere.
    """
    long = df.select(F.col(target).cast("double").alias("_y"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_x")) for c in features])))
    long = long.where((F.abs("_x") < float("inf")) & (F.abs("_y") < float("inf")))  # NaN is above infinity
    scale = long.groupBy("feature").agg(F.stddev_pop("_x").alias("_sx"), F.stddev_pop("_y").alias("_sy"))
    on_grid = lambda v, s: F.coalesce(F.round(F.try_divide(v, s) * GRID), F.lit(0.0)).cast("long")
    placed = long.join(F.broadcast(scale), "feature")  # one row for each feature
    return placed.select("feature", on_grid(F.col("_x"), F.col("_sx")).alias("x"), on_grid(F.col("_y"), F.col("_sy")).alias("y")).groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("w"))


def nearest(points: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Distances of the k nearest of `points` (n x 2) to each of `queries`, ascending; FAR where there are fewer.

    Points are walked outwards along the axis that has more values, all queries together, each until
    the gap along that axis reaches its k-th distance.
    """
    best = np.full((len(queries), k), FAR, np.int64)
    if not len(points) or not len(queries):
        return best
    axis = int(len(np.unique(points[:, 1])) > len(np.unique(points[:, 0])))
    points = points[np.argsort(points[:, axis], kind="stable")]
    middle = np.searchsorted(points[:, axis], queries[:, axis])
    for step, first in ((-1, middle - 1), (1, middle)):
        live, at = np.arange(len(queries)), first.copy()
        while len(live):
            inside = (at >= 0) & (at < len(points))
            live, at = live[inside], at[inside]
            gaps = np.abs(points[at] - queries[live])
            near = gaps[:, axis] < best[live, -1]
            live, at, gaps = live[near], at[near], gaps[near]
            rows = best[live]
            rows[:, -1] = np.minimum(rows[:, -1], gaps.max(1))
            rows.sort(1)
            best[live] = rows
            at = at + step
    return best


def _edges(x: Column, parts: int) -> Column:
    return F.percentile_approx(x, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 20 * parts) if parts > 1 else F.array().cast("array<bigint>")


def _cell(value: Column, edges: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= value))


def _distances(own: DataFrame, k: int, cell_rows: int) -> DataFrame:
    """(feature, x, y, w, e): e is the distance to the k-th other point.

    Cells hold about `cell_rows` points: bands of x, each cut along y. A point's neighbours in its own
    cell bound e; where that square leaves the cell, the other cells that it meets are asked too.
    """
    n = own.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    parts = min(512, max(1, math.ceil(math.sqrt(n / cell_rows))))
    bands = own.groupBy("feature").agg(_edges(F.col("x"), parts).alias("bands"))
    banded = own.join(F.broadcast(bands), "feature").withColumn("band", _cell(F.col("x"), F.col("bands"))).drop("bands")
    slabs = banded.groupBy("feature", "band").agg(_edges(F.col("y"), parts).alias("slabs"))
    placed = banded.join(slabs, ["feature", "band"]).withColumn("slab", _cell(F.col("y"), F.col("slabs"))).drop("slabs")
    key, long3 = ["feature", "band", "slab"], "x long, y long, w long"

    def inside(cell: pa.Table) -> pa.Table:
        xy, w = np.column_stack([cell.column("x").to_numpy(), cell.column("y").to_numpy()]), cell.column("w").to_numpy()
        copies = np.repeat(xy, np.minimum(w, k + 1), axis=0)
        found = nearest(copies, xy, k + 1)[:, 1:]  # the first is the point itself
        return pa.table({**{c: cell.column(c) for c in (*key, "x", "y", "w")}, "near": pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), k).cast(pa.list_(pa.int64()))})

    placed = checkpointed(placed)
    first = checkpointed(placed.groupBy(*key).applyInArrow(inside, f"feature string, band int, slab int, {long3}, near array<long>"))
    e = F.col("near")[k - 1]
    asked = first.join(F.broadcast(bands), "feature").select(
        "feature", "x", "y", "w", "band", "slab", e.alias("e"),
        F.explode(F.sequence(_cell(F.col("x") - e, F.col("bands")), _cell(F.col("x") + e, F.col("bands")))).alias("to_band"),
    ).join(slabs.withColumnRenamed("band", "to_band"), ["feature", "to_band"])
    asked = asked.withColumn("to_slab", F.explode(F.sequence(_cell(F.col("y") - F.col("e"), F.col("slabs")), _cell(F.col("y") + F.col("e"), F.col("slabs")))))
    asked = asked.where("e > 0 and not (band = to_band and slab = to_slab)").select("feature", F.col("to_band").alias("q_band"), F.col("to_slab").alias("q_slab"), "x", "y", "w").withColumnRenamed("feature", "q_feature")

    def outside(cell: pa.Table, queries: pa.Table) -> pa.Table:
        xy = np.column_stack([cell.column("x").to_numpy(), cell.column("y").to_numpy()])
        copies = np.repeat(xy, np.minimum(cell.column("w").to_numpy(), k), axis=0)
        found = nearest(copies, np.column_stack([queries.column("x").to_numpy(), queries.column("y").to_numpy()]), k)
        return pa.table({"feature": queries.column("q_feature"), **{c: queries.column(c) for c in ("x", "y", "w")}, "near": pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), k).cast(pa.list_(pa.int64()))})

    others = placed.select(*key, "x", "y", "w").groupBy(*key).cogroup(asked.groupBy("q_feature", "q_band", "q_slab")).applyInArrow(outside, f"feature string, {long3}, near array<long>")
    both = first.select("feature", "x", "y", "w", "near").union(others)
    return both.groupBy("feature", "x", "y", "w").agg(F.array_sort(F.flatten(F.collect_list("near")))[k - 1].alias("e"))


def _counts_up_to(own: DataFrame, asked: DataFrame) -> DataFrame:
    """own: (feature, axis, v, w). asked: (feature, axis, v). The distinct rows of asked with `upto`, the weight of own values at or under v.

    Values are summed inside buckets of 2 ** BUCKET_BITS, on top of the buckets before.
    """
    rows = own.unionByName(asked.distinct().withColumn("w", F.lit(None).cast("long"))).withColumn("bucket", F.shiftright("v", BUCKET_BITS))
    sums = rows.groupBy("feature", "axis", "bucket").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("s"))
    before = Window.partitionBy("feature", "axis").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("feature", "axis", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("feature", "axis", "bucket").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.coalesce(F.sum("w").over(inside), F.lit(0))).where("w is null")
    return rows.join(sums, ["feature", "axis", "bucket"]).select("feature", "axis", "v", (F.col("upto") + F.col("before")).alias("upto"))


def digamma(n: Column) -> Column:
    """The digamma function of a positive whole number, to 1e-12."""
    x = n.cast("double")
    y = x + 10
    inverse = 1 / (y * y)
    series = F.ln(y) - 1 / (2 * y) - inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse / 240)))
    for j in range(10):
        series = series - 1 / (x + j)
    return series


def mutual_information(df: DataFrame, features: list[str], target: str, k: int = 3, cell_rows: int = 1024) -> DataFrame:
    """(feature, n, information): mutual information with the target in nats, 0 or more; null for fewer than k + 1 rows."""
    own = checkpointed(points(df, features, target))
    near = checkpointed(_distances(own, k, cell_rows))
    h = F.greatest("e", F.lit(1).cast("long"))
    ends = [F.struct(F.lit(axis).alias("axis"), (F.col(axis) + v).alias("v"), F.lit(sign).alias("sign")) for axis in ("x", "y") for v, sign in ((h - 1, 1), (-h, -1))]
    asked = near.select("feature", "x", "y", "w", F.inline(F.array(*ends)))
    values = own.select("feature", F.inline(F.array(*[F.struct(F.lit(axis).alias("axis"), F.col(axis).alias("v")) for axis in ("x", "y")])), "w")
    counts = _counts_up_to(values.groupBy("feature", "axis", "v").agg(F.sum("w").alias("w")), asked.select("feature", "axis", "v"))
    within = lambda axis: F.sum(F.when(F.col("axis") == axis, F.col("sign") * F.col("upto"))).alias(f"n_{axis}")  # noqa: E731  with the row itself
    near = asked.join(counts, ["feature", "axis", "v"]).groupBy("feature", "x", "y", "w").agg(within("x"), within("y"))
    each = F.col("w") * (digamma(F.col("n_x")) + digamma(F.col("n_y")))
    n = F.sum("w")
    raw = digamma(n) + digamma(F.lit(k)) - F.sum(each) / n
    return near.groupBy("feature").agg(n.alias("n"), F.when(n > k, F.greatest(raw, F.lit(0.0))).alias("information"))


def most_informative(scores: DataFrame, share: float = 0.5, by: str = "information") -> DataFrame:
    """The best `share` of the features, at least one, first by name among equals; one row per feature is ranked."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(by), "feature")
    all_ = Window.partitionBy(F.lit(1))
    x = scores.withColumn("place", F.row_number().over(w)).withColumn("selected", (F.col("place") <= F.greatest(F.floor(F.count(F.lit(1)).over(all_) * share), F.lit(1))).cast("long"))
    return x.drop("place")


def plain_information(x: pd.Series, y: pd.Series, k: int = 3) -> float:
    """The same by comparing all points; for small tables."""
    scaled = [np.round(v.to_numpy(float) / np.std(v.to_numpy(float)) * GRID).astype(np.int64) if np.std(v.to_numpy(float)) else np.zeros(len(v), np.int64) for v in (x, y)]
    gaps = [np.abs(v[:, None] - v[None, :]) for v in scaled]
    e = np.sort(np.maximum(*gaps), axis=1)[:, k]
    h = np.maximum(e, 1)[:, None]
    harmonic = np.append(0.0, np.cumsum(1 / np.arange(1, len(x) + 1)))
    psi = lambda n: harmonic[n - 1] - np.euler_gamma
    return max(0.0, float(psi(len(x)) + psi(k) - np.mean(psi((gaps[0] < h).sum(1)) + psi((gaps[1] < h).sum(1)))))
