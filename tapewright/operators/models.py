"""Model jobs with pyspark.ml: folds, fits, calibration, importances, clustering."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)


def cross_fitted(df: DataFrame, columns: list[str], label: str, folds: int = 3, id_column: str = "row") -> DataFrame:
    """Out-of-fold predictions of a linear model; folds by hash of the id."""
    x = vectors(df, columns).withColumn("fold", F.pmod(F.xxhash64(id_column), F.lit(folds)))
    out = None
    for k in range(folds):
        model = LinearRegression(labelCol=label, regParam=0.01).fit(x.where(F.col("fold") != k))
        p = model.transform(x.where(F.col("fold") == k)).select(id_column, "fold", F.col(label).alias("y"), F.col("prediction").alias("p"))
        out = p if out is None else out.union(p)
    return out


def importances(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    model = RandomForestRegressor(labelCol=label, numTrees=20, maxDepth=4, seed=7).fit(vectors(df, columns))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())], "feature string, importance double")


def adversarial(df: DataFrame, columns: list[str], is_test: str) -> DataFrame:
    """AUC of telling test rows from training rows; over 0.6 the two differ."""
    x = vectors(df.withColumn("label", F.col(is_test).cast("double")), columns)
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=7).fit(x.where(F.pmod(F.xxhash64("row"), F.lit(2)) == 0))
    auc = BinaryClassificationEvaluator().evaluate(model.transform(x.where(F.pmod(F.xxhash64("row"), F.lit(2)) == 1)))
    return df.groupBy().agg(F.count(F.lit(1)).alias("n")).withColumns({"auc": F.lit(float(auc)), "shifted": F.lit(int(auc > 0.6))})


def calibrated(df: DataFrame, score: str, label: str) -> DataFrame:
    """Platt and isotonic calibration of a score."""
    x = vectors(df.withColumn("label", F.col(label).cast("double")), [score])
    platt = LogisticRegression().fit(x)
    p = platt.transform(x).withColumn("platt", F.element_at(_array("probability"), 2)).drop("prediction", "probability", "rawPrediction")
    return IsotonicRegression().fit(p).transform(p).withColumnRenamed("prediction", "isotonic").drop("features")


def _array(column: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(column))


def clustered_regimes(df: DataFrame, x: str, k: int = 3) -> DataFrame:
    """k-means regimes of one column, numbered by their centres."""
    v = vectors(df.where(F.col(x).isNotNull()), [x])
    model = KMeans(k=k, seed=7).fit(v)
    order = {i: n for n, (i, _) in enumerate(sorted(enumerate(float(c[0]) for c in model.clusterCenters()), key=lambda t: t[1]))}
    names = F.create_map(*[F.lit(z) for pair in order.items() for z in pair])
    return model.transform(v).withColumn("regime", names[F.col("prediction")]).drop("features", "prediction")
