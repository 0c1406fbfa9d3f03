"""Least-squares probes (M2, M3) on Spark ML; the logistic ones are in :mod:`.solver`."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_probe(df: DataFrame, arr: str, y: str, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """M2 (M3 after pad + flatten): least squares by the normal equations,
    trained on split 0; scores = MSE on split 1."""
    data = df.withColumn("features", array_to_vector(F.transform(arr, lambda x: x.cast("double")))) \
             .withColumn("_y", F.col(y).cast("double"))
    model = LinearRegression(featuresCol="features", labelCol="_y", solver="normal", regParam=0.0) \
        .fit(data.filter(F.col(split) == 0))
    pred = model.transform(data.filter(F.col(split) == 1))
    scores = pred.agg(F.avg(F.pow(F.col("_y") - F.col("prediction"), 2)).alias("mse"), F.count("*").alias("n_test"))
    return pred, scores
