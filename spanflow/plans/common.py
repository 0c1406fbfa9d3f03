"""Shared definitions of the test-table inputs used by several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexing import PIECE_PATTERN, PROSE_PATTERN
from ..sources.tables import load

SUPPORTED_LANGS = ("en", "de")


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return load(spark, sf, name)


def keys(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    """Key columns of a table from which a query builds larger rows.  They are dealt out anew: a table of millions
    of rows may be a few MB, which Spark reads in one task, and all that is built from it would stay there."""
    return load(spark, sf, name).select(*cols).repartition(4 * spark.sparkContext.defaultParallelism)


def r6(c):
    """Doubles are compared rounded to 6 digits."""
    return F.round(c.cast("double"), 6)


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_pieces(table: str, text: str, key: str, pattern: str) -> str:
    """DuckDB: pieces of a pattern with their 0-based position and start."""
    return f"""
      SELECT {key} AS doc_id, pos, piece,
             coalesce(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY pos
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start
      FROM (SELECT {key}, unnest(arr) AS piece, generate_subscripts(arr, 1) - 1 AS pos
            FROM (SELECT {key}, regexp_extract_all({text}, {sql_str(pattern)}, 1) AS arr FROM {table}))"""


def sql_tokens(table: str = "documents", text: str = "text", key: str = "doc_id",
               pattern: str = PROSE_PATTERN) -> str:
    """DuckDB twin of ``token_table`` (prose, no line columns)."""
    return f"""
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS idx,
             piece AS text, char_start::INTEGER AS char_start,
             (char_start + length(piece))::INTEGER AS char_end
      FROM ({sql_pieces(table, text, key, pattern)})
      WHERE NOT regexp_matches(piece, '^[ \\t\\n\\r\\f]')"""


def sql_label(t: str = "text") -> str:
    """DuckDB twin of ``token_label``."""
    from ..functions.lexing import JAVA_KEYWORDS
    kws = ", ".join(sql_str(k) for k in JAVA_KEYWORDS)
    return f"""CASE WHEN regexp_full_match({t}, '(0|[1-9][0-9_]*)[lL]?') THEN 'decimal_integer_literal'
      WHEN regexp_matches({t}, '^0[xX]') THEN 'hex_integer_literal'
      WHEN regexp_full_match({t}, '0[bB][01_]+[lL]?') THEN 'binary_integer_literal'
      WHEN regexp_full_match({t}, '0[0-7_]+[lL]?') THEN 'octal_integer_literal'
      WHEN regexp_full_match({t}, '[0-9][0-9_]*(\\.[0-9_]+)?([eE][+-]?[0-9]+)?[fFdD]?') THEN 'decimal_floating_point_literal'
      WHEN starts_with({t}, '"') THEN 'string_literal'
      WHEN starts_with({t}, '''') AND length({t}) >= 3 THEN 'character_literal'
      WHEN {t} = 'null' THEN 'null_literal'
      WHEN {t} IN ('void', 'boolean') THEN {t} || '_type'
      WHEN {t} IN ({kws}) THEN {t}
      WHEN regexp_full_match({t}, '[\\p{{L}}\\p{{M}}\\p{{N}}_$]+') THEN 'identifier'
      ELSE {t} END"""


def sql_draw_int(lo: int, hi: int, key_sql: str, inclusive: bool = False) -> str:
    span = hi - lo + (1 if inclusive else 0)
    return f"({lo} + (('0x' || substr(md5({key_sql}), 1, 13))::BIGINT % {span}))"


def sql_draw_float(lo: float, hi: float, key_sql: str) -> str:
    return (f"({float(lo)!r} + ({float(hi)!r} - {float(lo)!r}) * "
            f"((('0x' || substr(md5({key_sql}), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0))")


def sql_number_words(n: str) -> str:
    from ..functions.scalars import TENS, UNITS
    units = "[" + ", ".join(sql_str(w) for w in UNITS) + "]"
    tens = "[" + ", ".join(sql_str(w) for w in TENS) + "]"
    a = f"abs({n})"
    word = (f"CASE WHEN {a} < 20 THEN {units}[{a} + 1] WHEN {a} < 100 THEN {tens}[{a} // 10 + 1] || "
            f"CASE WHEN {a} % 10 <> 0 THEN '-' || {units}[{a} % 10 + 1] ELSE '' END END")
    return f"CASE WHEN {n} < 0 THEN 'minus ' || ({word}) ELSE ({word}) END"


def sql_signed_log(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) WHEN {x} < 0 THEN -ln(-({x})) ELSE 0.0 END"
