"""Feature selection and importance: resampled, permuted, partial, by fold, by correlation, by elimination.

Linear importances come from one aggregate of products (`functions.regression`): a feature's absolute
coefficient times its deviation, as a share of all. What is ranked or walked over here has one row, or
one cell, for each feature or pair of features.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import regression as L
from tapewright.functions import rolling as R
from tapewright.functions.staging import checkpointed
from tapewright.operators.simulation import draw

#: Range of a draw.
DRAWS = 2**32
#: Shares of a Poisson variable of mean 1 that are at most 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999898050889, 0.99999887479, 0.9999998885745, 0.99999998995)


def complete(df: DataFrame, features: list[str], target: str) -> DataFrame:
    return R.given(df, [*features, target])


def _terms(features: list[str], target: str) -> list[Column]:
    return [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(target).cast("double")]


def linear_importances(sums: Column, features: list[str]) -> Column:
    """Array of {feature, importance} from the products of 1, the features and the target; shares of their sum."""
    m = len(features) + 2
    a = L.solved(sums, m)
    raw = F.array(*[F.abs(L.coefficient(a, i + 1, m)) * L.spread(sums, i + 1, m) for i in range(len(features))])
    total = F.aggregate(raw, F.lit(0.0), lambda x, y: x + F.coalesce(y, F.lit(0.0)))
    return F.zip_with(F.array(*map(F.lit, features)), raw, lambda f, v: F.struct(f.alias("feature"), F.coalesce(F.try_divide(v, total), F.lit(0.0)).alias("importance")))


def importances(df: DataFrame, features: list[str], target: str, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(by, feature, importance): linear importances in each group."""
    by = by or []
    g = complete(df, features, target).groupBy(*by).agg(L.products(_terms(features, target), weight).alias("_sums"), F.count(F.lit(1)).alias("_n")).where("_n > 0")
    return g.select(*by, F.inline(linear_importances(F.col("_sums"), features)))


def poisson_weight(*on: Column | str, seed: int = 7) -> Column:
    """How often a row comes in a resample: a Poisson variable of mean 1 by a hash of (seed, on)."""
    u = draw(seed, *on) / DRAWS
    out = F.lit(0)
    for cut in POISSON:
        out = out + (u >= cut).cast("int")
    return out


def stability_selection(df: DataFrame, features: list[str], target: str, row: str, resamples: int = 50, seed: int = 7, share: float = 0.5, least: int = 10) -> DataFrame:
    """(feature, stability, selected): in which share of resamples a feature is among the best half.

    Every resample weighs each row by a draw from (seed, resample, row), so all are made of one scan and
    any partitioning gives the same. Features chosen in `share` of the resamples are selected; if they are
    fewer than `least`, the `least` most stable ones are. Ties go by name.
    """
    drawn = complete(df, features, target).withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    drawn = drawn.withColumn("_w", poisson_weight("resample", row, seed=seed)).where("_w > 0")
    by_resample = importances(drawn, features, target, ["resample"], F.col("_w"))
    w = Window.partitionBy("resample").orderBy(F.desc(F.round("importance", 9)), "feature")
    top = by_resample.withColumn("_top", (F.row_number().over(w) <= max(1, len(features) // 2)).cast("double"))
    scores = top.groupBy("feature").agg(F.avg("_top").alias("stability"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("stability"), "feature"))  # one row per feature
    kept = F.count_if(F.col("stability") >= share).over(Window.partitionBy(F.lit(1)))
    return scores.withColumn("selected", F.when(kept < least, place <= least).otherwise(F.col("stability") >= share).cast("long"))


def shuffled_place(df: DataFrame, by: list[str], order: Column, row: str, name: str, parts: int = 256) -> DataFrame:
    """Adds a place from 0, gapless inside `by`, in the order of a draw and the row's id: a random permutation.

    Draws are even, so their high bits deal the rows to `parts` equal parts in order; places inside a
    part are counted on top of the parts before.
    """
    df = df.withColumn("_h", order).withColumn("_part", F.floor(F.col("_h") / (DRAWS / parts)).cast("int"))
    before = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_h", row)) - 1
    return df.withColumn("_at", inside).join(counts, [*by, "_part"]).withColumn(name, F.col("_at") + F.col("_before")).drop("_h", "_part", "_at", "_before")


def permutation_importance(df: DataFrame, features: list[str], target: str, row: str, predict: Callable[[DataFrame], DataFrame], repeats: int = 5, seed: int = 7) -> DataFrame:
    """(feature, importance, sd, share): how much the mean squared error grows when a feature's values are dealt anew, over `repeats`.

    predict adds `prediction` to rows that have the features. Each repeat is one permutation of all rows
    (by `row`, which must be unique), drawn from (seed, repeat, row); the row at a place gets the
    feature's value of the row that the permutation puts there.
    """
    own = checkpointed(shuffled_place(complete(df, features, target).select(row, target, *features), [], draw(seed, F.lit("own"), row), row, "place"))
    donors = own.select(row, *[F.col(c).alias(f"_d_{c}") for c in features]).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    donors = shuffled_place(donors, ["repeat"], draw(seed, "repeat", row), row, "place").drop(row)
    joined = own.join(donors, "place").withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    dealt = joined.withColumns({c: F.when(F.col("feature") == c, F.col(f"_d_{c}")).otherwise(F.col(c)) for c in features})
    error = F.avg((F.col(target) - F.col("prediction")) * (F.col(target) - F.col("prediction")))
    base = predict(own).agg(error.alias("_base"))
    grown = predict(dealt).groupBy("repeat", "feature").agg(error.alias("_mse")).crossJoin(F.broadcast(base))  # one row
    out = grown.groupBy("feature").agg(F.avg(F.col("_mse") - F.col("_base")).alias("importance"), F.stddev_pop(F.col("_mse") - F.col("_base")).alias("sd"))
    all_ = Window.partitionBy(F.lit(1))  # one row per feature
    return out.withColumn("share", F.try_divide(F.col("importance"), F.sum(F.abs("importance")).over(all_)))


def linear_model(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row: `_beta`, the constant and the coefficients of least squares."""
    m = len(features) + 2
    sums = complete(df, features, target).agg(L.products(_terms(features, target)).alias("_sums"))
    return sums.withColumn("_a", L.solved(F.col("_sums"), m)).select(F.array(*[L.coefficient(F.col("_a"), i, m) for i in range(m - 1)]).alias("_beta"))


def linear_predictor(model: DataFrame, features: list[str]) -> Callable[[DataFrame], DataFrame]:
    """predict for a linear model; the model is one row."""

    def predict(df: DataFrame) -> DataFrame:
        value = F.get("_beta", F.lit(0))
        for i, c in enumerate(features):
            value = value + F.get("_beta", F.lit(i + 1)) * F.col(c)
        return df.crossJoin(F.broadcast(model)).withColumn("prediction", value).drop("_beta")

    return predict


def partial_dependence(df: DataFrame, features: list[str], predict: Callable[[DataFrame], DataFrame], on: list[str], points: int = 50, ends: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """(on, prediction): mean prediction of all rows with the features `on` set to each point of a grid between their percentiles.

    One feature, or two for their joint effect. Every row is predicted at every point, which is the
    definition; means are taken before anything is shuffled.
    """
    rows = R.given(df, features).select(*features)
    grid = None
    for c in on:
        q = R.percentiles(rows, c, ends).withColumnRenamed("q", f"_q_{c}")  # one row
        grid = q if grid is None else grid.crossJoin(q)
    for c in on:
        low, high = F.get(f"_q_{c}", F.lit(0)), F.get(f"_q_{c}", F.lit(1))
        grid = grid.withColumn(f"_k_{c}", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(f"_g_{c}", low + (high - low) * F.col(f"_k_{c}") / max(points - 1, 1))
    grid = grid.select(*[f"_g_{c}" for c in on])
    at = predict(rows.drop(*on).crossJoin(F.broadcast(grid)).withColumns({c: F.col(f"_g_{c}") for c in on}))  # points ** len(on) rows
    return at.groupBy(*on).agg(F.avg("prediction").alias("prediction"))


def fold_stability(by_fold: DataFrame) -> DataFrame:
    """(feature, mean, sd, low, high, variation, place) of (fold, feature, importance); place: rank of the variation, the steadiest first."""
    x = F.col("importance")
    g = by_fold.groupBy("feature").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))
    g = g.withColumn("variation", F.col("sd") / (F.abs("mean") + 1e-10))
    return g.withColumn("place", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.round("variation", 9))).cast("long"))  # one row per feature


def correlations(df: DataFrame, features: list[str]) -> list[list[float]]:
    """The features' correlations, 0 where one doesn't vary: one aggregate, features squared values on the driver."""
    k = len(features)
    pairs = {(i, j): F.coalesce(F.corr(features[i], features[j]), F.lit(0.0)) for i in range(k) for j in range(i + 1, k)}
    row = df.agg(*[c.alias(f"{i}_{j}") for (i, j), c in pairs.items()]).first()
    return [[1.0 if i == j else row[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]


def uncorrelated(df: DataFrame, features: list[str], most: float = 0.95) -> DataFrame:
    """(feature, score, selected): of two features that correlate by more than `most`, the one that correlates more with all goes; score is 1 less that mean."""
    above = lambda a, b: not math.isnan(b) and (math.isnan(a) or a > b)  # noqa: E731  NaN is above all numbers, as in the sort order
    c = correlations(df, features)
    means = [sum(map(abs, r)) / len(r) for r in c]
    dropped: set[int] = set()
    for i in range(len(features)):
        if i in dropped:
            continue
        for j in range(i + 1, len(features)):
            if j not in dropped and above(abs(c[i][j]), most):
                dropped.add(i if above(means[i], means[j]) else j)
    return df.sparkSession.createDataFrame([(f, 1 - means[i], int(i not in dropped)) for i, f in enumerate(features)], "feature string, score double, selected long")


def eliminated(df: DataFrame, features: list[str], target: str, keep: int) -> DataFrame:
    """(feature, place): recursive elimination; the weakest feature goes, the rest are fitted again, until `keep` stay (place 1).

    One aggregate: a feature is taken out of the fit by undoing its exchange step.
    """
    m = len(features) + 2
    own = complete(df, features, target).agg(L.products(_terms(features, target)).alias("_sums"))
    own = own.withColumn("_a", L.solved(F.col("_sums"), m)).withColumn("_gone", F.array().cast("array<int>"))
    spreads = F.array(*[L.spread(F.col("_sums"), i, m) for i in range(1, m - 1)])
    for _ in range(len(features) - keep):
        live = F.filter(F.sequence(F.lit(1), F.lit(m - 2)), lambda i: ~F.array_contains("_gone", i))
        strength = F.transform(live, lambda i: F.struct(F.round(F.abs(F.get("_a", i * m + m - 1)) * F.get(spreads, i - 1), 9).alias("v"), i.alias("i")))
        own = own.withColumn("_weak", F.array_min(strength)["i"]).withColumn("_a", L.exchanged(F.col("_a"), F.col("_weak"), m)).withColumn("_gone", F.concat("_gone", F.array("_weak"))).drop("_weak")
    names = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i + 1).alias("i")) for i, c in enumerate(features)])
    at = F.array_position("_gone", F.col("i"))
    return own.select("_gone", F.inline(names)).select("feature", F.when(at == 0, 1).otherwise(F.size("_gone") - at + 2).cast("long").alias("place"))


def voted(selections: list[DataFrame], votes: int = 2) -> DataFrame:
    """(feature, score, selected): the share of selections that have a feature; selected by `votes` of them."""
    all_ = selections[0].select("feature", "selected")
    for s in selections[1:]:
        all_ = all_.union(s.select("feature", "selected"))
    return all_.groupBy("feature").agg(F.avg("selected").alias("score"), (F.sum("selected") >= votes).cast("long").alias("selected"))


def steady(by_part: DataFrame, share: float = 0.5) -> DataFrame:
    """(feature, mean, ratio, selected) of (part, feature, importance): the half with the best mean over deviation."""
    g = by_part.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("_sd"))
    g = g.withColumn("ratio", F.col("mean") / (F.col("_sd") + 1e-10))
    w = Window.partitionBy(F.lit(1))  # one row per feature
    place = F.row_number().over(w.orderBy(F.desc(F.round("ratio", 9)), "feature"))
    return g.withColumn("selected", (place <= F.greatest(F.floor(F.count(F.lit(1)).over(w) * share), F.lit(1))).cast("long")).drop("_sd")


def least_telling(df: DataFrame, features: list[str], late: str, share: float = 0.9) -> DataFrame:
    """(feature, importance, selected): the `share` of features that tell late rows from early ones least."""
    g = importances(df, features, late)
    w = Window.partitionBy(F.lit(1))  # one row per feature
    place = F.row_number().over(w.orderBy(F.round("importance", 9), "feature"))
    return g.withColumn("selected", (place <= F.greatest(F.floor(F.count(F.lit(1)).over(w) * share), F.lit(1))).cast("long"))
