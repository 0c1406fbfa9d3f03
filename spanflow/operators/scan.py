"""Skew-safe ordered scans within groups.

A window ``PARTITION BY key ORDER BY ...`` sends a whole group to one task;
a key holding a third of all rows would be a third of the job in a single
task.  These scans cut each group into *chunks*: ranges of the order given
by a column that never decreases along the order (an hour of a timestamp, a
line number, a block id).  The window runs per ``(key, chunk)``, so a hot key
spreads over as many tasks as it has chunks; what a chunk needs from the
chunks before it (a row count, the last definition) comes from a per-chunk
summary, which has one row per ``(key, chunk)``, is aggregated partially
before its shuffle, and is joined back on ``(key, chunk)`` - the side the
window already partitioned that way.  Everything is a function of the row
values (no sampling, no partition ids), so a recomputed task after an
executor loss gets the same answer.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _chunked(df: DataFrame, chunk: Column | str | None) -> DataFrame:
    c = F.lit(0) if chunk is None else (F.col(chunk) if isinstance(chunk, str) else chunk)
    return df.withColumn("_chunk", c)


def _with_carry(local: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Join a per-chunk summary back; NULL keys and chunks are values like others."""
    renamed = carry.withColumnsRenamed({k: f"_c_{k}" for k in [*keys, "_chunk"]})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in [*keys, "_chunk"]))
    return local.join(renamed, same).drop(*[f"_c_{k}" for k in [*keys, "_chunk"]])


def group_positions(df: DataFrame, keys: list[str], order: list[str], name: str = "pos",
                    chunk: Column | str | None = None) -> DataFrame:
    """0-based position of each row within its group, by ``order``."""
    d = _chunked(df, chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = d.withColumn("_lpos", F.row_number().over(w) - 1)
    if chunk is None:
        return local.withColumn(name, F.col("_lpos").cast("long")).drop("_chunk", "_lpos")
    counts = d.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(wc), F.lit(0)).alias("_off"))
    out = _with_carry(local, carry, keys)
    return out.withColumn(name, (F.col("_lpos") + F.col("_off")).cast("long")).drop("_chunk", "_lpos", "_off")


def last_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str,
                chunk: Column | str | None = None) -> DataFrame:
    """The last non-null ``value`` strictly before each row within its group
    (an as-of lookup, e.g. the reaching definition of a use)."""
    d = _chunked(df, chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("_lv", F.last(value, ignorenulls=True).over(w))
    if chunk is None:
        return local.withColumnRenamed("_lv", name).drop("_chunk")
    per = (d.groupBy(*keys, "_chunk")
             .agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last")))
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, "_chunk", F.last("_last", ignorenulls=True).over(wc).alias("_c"))
    out = _with_carry(local, carry, keys)
    return out.withColumn(name, F.coalesce(F.col("_lv"), F.col("_c"))).drop("_chunk", "_lv", "_c")
