"""Models on drawing features: closed-form regression from one pass of sums, and Spark's own classifier."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from strokelake.functions.labels import class_count_of


def training_mode(feature: str) -> str:
    return "classification" if class_count_of(feature) else "regression"


@dataclass
class LinearFit:
    """prediction = intercept + coefficients . features; a missing feature counts as zero, as in the fit."""

    coefficients: list[float]
    intercept: float
    rows: int

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        value = F.lit(self.intercept)
        for at, c in enumerate(self.coefficients):
            value = value + F.lit(c) * F.coalesce(F.get(features, F.lit(at)), F.lit(0.0))
        return df.withColumn("prediction", value)


def moment_table(train: DataFrame, features: str, target: str) -> np.ndarray:
    """Sums of the products of (1, features, target), a square table of fixed size, by one mergeable pass.

    Rows without target or features take no part. Each task adds up its own batches; Spark adds the tables of the tasks.
    """
    rows = train.where(F.col(target).isNotNull() & F.col(features).isNotNull())
    size = rows.agg(F.max(F.size(features))).first()[0]
    if size is None:
        raise ValueError("no row to fit on")
    wide = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.get(features, i).cast("double"), F.lit(0.0))) if size else F.array().cast("array<double>")
    rows = rows.select(F.concat(F.array(F.lit(1.0)), wide, F.array(F.col(target).cast("double"))).alias("z"))
    side = size + 2

    def add(batches):
        table = np.zeros((side, side))
        for batch in batches:
            z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, side)
            table += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(side * side)), pa.array(table.ravel())], names=["at", "value"])

    out = np.zeros(side * side)
    for r in rows.mapInArrow(add, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r.at] = r.value
    return out.reshape(side, side)


def fit_linear(train: DataFrame, features: str = "features", target: str = "target", regularise: float = 0.01) -> LinearFit:
    """Least mean square error plus ``regularise`` times the squared coefficients; the intercept is free."""
    table = moment_table(train, features, target)
    n = table[0, 0]
    if not n:
        raise ValueError("no row to fit on")
    mean = table[0] / n
    cov = table / n - np.outer(mean, mean)
    inner = cov[1:-1, 1:-1] + regularise * np.eye(len(cov) - 2)
    # a constant or repeated feature has no unique weight; the smallest one is taken
    weights = np.linalg.lstsq(inner, cov[1:-1, -1], rcond=None)[0]
    return LinearFit(weights.tolist(), float(mean[-1] - weights @ mean[1:-1]), int(n))


def fit_model(
    train: DataFrame, feature: str, features: str = "features", target: str = "target", regularise: float = 0.01
) -> Model | LinearFit:
    """Fit on an array column of features; the mode follows from the target's name."""
    if training_mode(feature) == "regression":
        return fit_linear(train, features, target, regularise)
    rows = train.select(array_to_vector(F.col(features)).alias("_x"), F.col(target).cast("double").alias("_y"))
    return LogisticRegression(family="multinomial", featuresCol="_x", labelCol="_y", regParam=regularise, maxIter=50).fit(rows)


def predict(model: Model | LinearFit, df: DataFrame, features: str = "features") -> DataFrame:
    """Predictions in one distributed pass; classifiers add their logits."""
    if isinstance(model, LinearFit):
        return model.transform(df, features)
    scored = model.transform(df.withColumn("_x", array_to_vector(F.col(features))))
    if "rawPrediction" in scored.columns:
        scored = scored.withColumn("logits", vector_to_array("rawPrediction")).drop("rawPrediction", "probability")
    return scored.drop("_x")
