"""Deterministic draws.  No ``rand()`` anywhere: a draw is a function of
(seed, row key, position) through md5, so a re-run after an executor loss,
another partitioning, and DuckDB all see the same numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = float(2 ** 52)


def _key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def draw_u32(*parts) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of md5(parts joined by ':')."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 8), 16, 10).cast("bigint")


def draw_u52(*parts) -> Column:
    """52-bit integer (13 hex digits), exact in a double."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 13), 16, 10).cast("bigint")


def draw_unit(*parts) -> Column:
    """Uniform double in [0, 1) with 52 bits."""
    return draw_u52(*parts).cast("double") / F.lit(TWO52)


def draw_int(lo, hi, *parts, inclusive: bool = False) -> Column:
    """Integer in [lo, hi) (numpy ``randint``) or [lo, hi] (``random.randint``)."""
    lo_c = F.lit(lo) if not isinstance(lo, Column) else lo
    hi_c = F.lit(hi) if not isinstance(hi, Column) else hi
    span = (hi_c - lo_c + (1 if inclusive else 0)).cast("bigint")
    return (lo_c.cast("bigint") + F.pmod(draw_u52(*parts), span)).cast("bigint")


def draw_float(lo, hi, *parts) -> Column:
    lo_c = F.lit(float(lo)) if not isinstance(lo, Column) else lo.cast("double")
    hi_c = F.lit(float(hi)) if not isinstance(hi, Column) else hi.cast("double")
    return lo_c + (hi_c - lo_c) * draw_unit(*parts)


def hash_split(id_col: Column | str, seed: int = 42, test_fraction_pct: int = 50) -> Column:
    """0 = train, 1 = test.  Stable under repartition and re-run, unlike
    ``randomSplit`` whose result depends on the partitioning."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.when(F.pmod(draw_u32(seed, c), F.lit(100)) < F.lit(100 - test_fraction_pct), 0).otherwise(1)


# DuckDB spellings of the same draws, for the oracle SQL.
def sql_u32(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


def sql_u52(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 13))::BIGINT"
