"""Probe metrics (A9-A14, P7 helpers).  All are aggregates; class-level
tables (weights, confusion cells) are bounded by the number of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy_pct(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """Percent of rows whose prediction equals the label; for array
    labels every position must match."""
    agg = (F.lit(100.0) * F.avg((F.col(y) == F.col(yhat)).cast("double"))).alias("accuracy")
    return df.groupBy(*(by or [])).agg(agg)


def mse(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """A10"""
    return df.groupBy(*(by or [])).agg(F.avg(F.pow(F.col(y) - F.col(yhat), 2)).alias("mse"))


def score(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy as a fraction."""
    return df.groupBy(*(by or [])).agg(F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """Long confusion matrix ``(by, actual, predicted, n)`` over the
    sorted label set of each group, zero cells included.  The label set is a
    ``collect_set`` (bounded by the number of classes), exploded twice."""
    by = by or []
    counts = df.groupBy(*by, F.col(y).alias("actual"), F.col(yhat).alias("predicted")).agg(F.count("*").alias("n"))
    labels = df.select(*by, F.explode(F.array(F.col(y), F.col(yhat))).alias("_l")) \
               .groupBy(*by).agg(F.collect_set("_l").alias("_ls"))
    cells = labels.select(*by, F.explode("_ls").alias("actual"), "_ls") \
                  .select(*by, "actual", F.explode("_ls").alias("predicted"))
    return cells.join(counts, [*by, "actual", "predicted"], "left").fillna(0, ["n"])


def balanced_weights(df: DataFrame, y: str, by: list[str] | None = None) -> DataFrame:
    """Weight of class c = n / (k * n_c).  Per-class counts first
    (partial aggregation); totals over that tiny table."""
    by = by or []
    per = df.groupBy(*by, y).agg(F.count("*").alias("n_c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return per.select(*by, y, "n_c",
                      (F.sum("n_c").over(w) / (F.count("*").over(w) * F.col("n_c"))).alias("weight"))


def with_weights(df: DataFrame, y: str, by: list[str] | None = None, name: str = "weight") -> DataFrame:
    """Attach A13 weights to rows.  The class table has a row per group and class; Spark
    broadcasts it only where its measured size allows."""
    wt = balanced_weights(df, y, by).select(*(by or []), y, F.col("weight").alias(name))
    return df.join(wt, [*(by or []), y])


def standardize(df: DataFrame, cols: list[str], fit_on: Column | None = None, suffix: str = "_z") -> DataFrame:
    """``(x - mean) / std`` with population std (std 0 -> 1), the
    statistics fitted on the rows where ``fit_on`` holds (train half).
    Fitting is one aggregate over all columns (two numbers per column come
    back, like any estimator's fit); applying it is a projection."""
    fit = df if fit_on is None else df.filter(fit_on)
    row = fit.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = df
    for i, c in enumerate(cols):
        mean, std = row[f"m{i}"], row[f"s{i}"]
        std = 1.0 if (std is None or std == 0) else std
        out = out.withColumn(c + suffix, (F.col(c).cast("double") - F.lit(mean)) / F.lit(std))
    return out
