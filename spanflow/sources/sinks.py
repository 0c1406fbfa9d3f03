"""Sinks (K1-K4).  Writes are idempotent per key: work whose key already has
output is skipped with an anti join (J1), never re-appended."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kernel import pending
from .tables import METHOD_FLAGS


def _existing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The stored output, or None where there is none; other errors are raised."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_dataset(df: DataFrame, path: str, error_if_exists: bool = True) -> int:
    """K1: append samples under their config; a config that is already stored
    is an error (as in the reference) or skipped.  Stored as parquet
    partitioned by ``task/type`` so readers prune by config."""
    spark = df.sparkSession
    old = _existing(spark, path)
    if old is not None:
        clash = df.select("config_name").distinct().join(old.select("config_name").distinct(), "config_name")
        if error_if_exists and clash.limit(1).count() > 0:
            raise ValueError(f"dataset for config {clash.first()[0]} has been already created")
        df = pending(df, old.select("config_name").distinct(), ["config_name"])
    df.write.mode("append").partitionBy("task", "type").parquet(path)
    return 0


def write_features(df: DataFrame, path: str) -> None:
    """K2: method-feature JSONL with the booleans as the strings true/false."""
    cols = [c for c in ("class", "method", "code") if c in df.columns]
    df.select(*cols, *[F.col(f).cast("string").alias(f) for f in METHOD_FLAGS if f in df.columns]) \
      .write.mode("overwrite").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """K3: long-format results ``(key, layer, metric, value)``, one folder per
    key; the combined view is simply a read of the whole folder.  A result
    that is stored already (key, layer, metric) is not written again."""
    old = _existing(df.sparkSession, path)
    df = df.dropDuplicates(["key", "layer", "metric"])
    if old is not None:
        df = pending(df, old.withColumn("key", F.col("key").cast(df.schema["key"].dataType)), ["key", "layer", "metric"])
    df.write.mode("append").partitionBy("key").parquet(path)


def stored_results(spark: SparkSession, path: str) -> DataFrame | None:
    """What :func:`write_results` has stored at ``path``, or None."""
    old = _existing(spark, path)
    return None if old is None else old.select(F.col("key").cast("string").alias("key"), "layer", "metric", "value")


def prepared(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """K4: materialize prepared data once per key and reuse it afterwards.
    Keys already stored are not recomputed (anti join), new ones are appended;
    the stored table is returned, cutting the lineage of ``df``."""
    spark = df.sparkSession
    old = _existing(spark, path)
    todo = df if old is None else pending(df, old.select(*keys).distinct(), keys)
    todo.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def bucketed_documents(df: DataFrame, table: str, path: str, buckets: int, key: str = "doc_id") -> DataFrame:
    """Store a documents table once, bucketed (and sorted) by ``key``, as an
    external table at ``path`` (shared storage on a cluster).  A scan of it
    reports hash partitioning on ``key``, so the per-document windows of the
    token pipeline run without shuffling the text at all
    (``token_table(..., partitioned=True)``).  ``buckets`` should give
    partitions of a few hundred MB."""
    (df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
       .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)
