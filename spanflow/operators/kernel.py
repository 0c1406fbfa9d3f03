"""Kernel operators: guards, error isolation, resume (J1), limits and
per-group top-n (P2, P4-P7, J1, L1, L2, L6)."""

from __future__ import annotations

from typing import Iterable

from pyspark.errors import PySparkAttributeError, PySparkNotImplementedError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw_u32, hash_split


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Make CPU-heavy per-row work parallel.  A big input already arrives in
    many scan splits and is returned as is (no shuffle); an input with fewer
    partitions than the cluster's default parallelism (e.g. one small
    parquet file = one split) is spread round-robin first."""
    try:
        n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except (AttributeError, PySparkAttributeError, PySparkNotImplementedError):  # a Spark Connect session has no RDD view
        return df
    return df.repartition(n) if have < n else df


def by_repetition(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key occurs once, rows whose key is repeated); rows with a NULL in the key are in the first.  The
    rows are shuffled once by their key; a repeated key is one row of what they are compared with."""
    more = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys)
    return df.join(more, keys, "left_anti"), df.join(more, keys, "left_semi")


def split_supported(df: DataFrame, lang_col: str, langs: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(rows in a supported language, rejected rows with a reason)."""
    langs = list(langs)
    ok = F.col(lang_col).isin(langs)
    return (df.filter(ok),
            df.filter(~ok | F.col(lang_col).isNull())
              .withColumn("reject_reason", F.concat(F.lit("unsupported language: "),
                                                    F.coalesce(F.col(lang_col), F.lit("null")))))


def select_configs(df: DataFrame, names: Iterable[str], col: str = "config_name") -> DataFrame:
    """Keep the requested configs (a literal IN list: pushed to the scan)."""
    return df.filter(F.col(col).isin(list(names)))


def drop_types(df: DataFrame, types: Iterable[str], col: str = "type") -> DataFrame:
    """P5"""
    return df.filter(~F.col(col).isin(list(types)))


def quarantine(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """``error`` is NULL for a good row, else the reason.  A bad row is
    kept aside (and counted by A15), never fatal."""
    tagged = df.withColumn("_error", error)
    return tagged.filter(F.col("_error").isNull()).drop("_error"), tagged.filter(F.col("_error").isNotNull())


def quarantine_counts(df: DataFrame, error: Column, by: list[str]) -> DataFrame:
    """Good and skipped rows per group, one aggregation pass."""
    return (df.withColumn("_error", error).groupBy(*by)
              .agg(F.count_if(F.col("_error").isNull()).alias("n_ok"),
                   F.count_if(F.col("_error").isNotNull()).alias("n_skipped")))


def drop_constant_targets(df: DataFrame, key: list[str], y: str, split_col: str | None = "split") -> DataFrame:
    """Keep keys whose target has more than one value in the train
    half; the check is an aggregate + semi join (keys are few)."""
    train = df if split_col is None else df.filter(F.col(split_col) == 0)
    ok = train.groupBy(*key).agg(F.count_distinct(y).alias("_k")).filter(F.col("_k") > 1).select(*key)
    return df.join(ok, key, "left_semi")


def named_tokens(tokens: DataFrame, label_col: str = "label", text_col: str = "text") -> DataFrame:
    """A leaf is a name or literal when its type differs from its text."""
    return tokens.filter(F.col(label_col) != F.col(text_col))


def true_features(flags: Iterable[str]) -> Column:
    """P10: names of the true flag columns, in order."""
    return F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key has no output yet.  The done keys are made
    distinct first (map-side), so a key with a lot of output is one row."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def first_docs(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """L1: the first ``n`` records by a source order key (a top-k: Spark
    plans it as TakeOrderedAndProject, n rows per task, no full sort)."""
    return df.orderBy(*order).limit(n)


def first_n_per_group(df: DataFrame, by: list[str], order: list[str], n: int,
                      salt_col: Column | None = None, salts: int = 16) -> DataFrame:
    """L2: the first ``n`` rows of each group, skew-safe.

    A hot group is first cut into ``salts`` sub-groups by a hash of the row;
    each sub-group keeps its own first ``n`` (at most n per sub-group), and
    only those candidates meet in the final ranking.  No task ever sees
    more than one sub-group of a hot key plus ``n * salts`` candidates."""
    salt = salt_col if salt_col is not None else F.pmod(F.xxhash64(*[F.col(c) for c in by + order]), F.lit(salts))
    w1 = Window.partitionBy(*by, "_salt").orderBy(*order)
    cand = (df.withColumn("_salt", salt)
              .withColumn("_r1", F.row_number().over(w1))
              .filter(F.col("_r1") <= n))
    w2 = Window.partitionBy(*by).orderBy(*order)
    return (cand.withColumn("rank", F.row_number().over(w2))
                .filter(F.col("rank") <= n)
                .drop("_salt", "_r1"))


def with_split(df: DataFrame, id_col: str, seed: int = 42, test_pct: int = 50) -> DataFrame:
    """Adds ``split`` (0 train / 1 test) from an md5 draw of the id."""
    return df.withColumn("split", hash_split(id_col, seed, test_pct))


__all__ = ["spread", "by_repetition", "split_supported", "select_configs", "drop_types", "quarantine", "quarantine_counts",
           "drop_constant_targets", "named_tokens", "true_features", "pending", "first_docs",
           "first_n_per_group", "with_split", "draw_u32"]
