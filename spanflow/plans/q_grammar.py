"""Step 5 queries: sampled derivations and their evaluation.  Samples are
the orders (one draw per order), so the work grows with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import draw_int
from ..functions.scalars import signed_log
from ..operators.grammar import (GRAMMARS, NT, counts, eval_arith, eval_bool, eval_var, fill_literals,
                                 production_counts, weighted_sample)
from .common import T, r6, sql_str
from .registry import query

DEPTH = 4


def sql_language(grammar: str, depth: int) -> str:
    """DuckDB: ``(k, s)`` for every derivation k within depth, numbered as
    ``unrank`` does (production order, leftmost item most significant).
    Built level by level (this joins levels; it is only the oracle)."""
    prods = GRAMMARS[grammar]
    C = counts(grammar, depth)
    ctes = ["L1 AS (SELECT 0::BIGINT AS k, '' AS s WHERE false)"]
    for d in range(2, depth + 1):
        pc = production_counts(grammar, d)
        start, parts = 0, []
        for rhs, c in zip(prods, pc):
            if c == 0:
                start += c
                continue
            nts = [i for i, s in enumerate(rhs) if s == NT]
            aliases = [f"a{j}" for j in range(len(nts))]
            frm = ", ".join(f"L{d - 1} {a}" for a in aliases) or "(SELECT 1) AS one"
            kexpr = str(start)
            for j, a in enumerate(aliases):
                kexpr += f" + {a}.k * {C[d - 1] ** (len(nts) - 1 - j)}"
            sexpr, j = [], 0
            for s in rhs:
                if s == NT:
                    sexpr.append(f"{aliases[j]}.s")
                    j += 1
                else:
                    sexpr.append(sql_str(s))
            parts.append(f"SELECT ({kexpr})::BIGINT AS k, concat_ws(' ', {', '.join(sexpr)}) AS s FROM {frm}")
            start += c
        ctes.append(f"L{d} AS ({' UNION ALL '.join(parts)})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT k, s FROM L{depth}"


def sql_draw_k(grammar: str, depth: int, key: str = "o_orderkey") -> str:
    total = counts(grammar, depth)[depth]
    return f"(('0x' || substr(md5('deriv:{grammar}:{depth}:' || {key}), 1, 13))::BIGINT % {total})"


def _sampled_sql(grammar: str, select: str) -> str:
    return f"""
SELECT {select} FROM orders o JOIN ({sql_language(grammar, DEPTH)}) lang ON lang.k = {sql_draw_k(grammar, DEPTH, 'o.o_orderkey')}"""


def _samples(spark, sf):
    return T(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"))


@query("weighted_sample", _sampled_sql("bool", "o.o_orderkey AS sample_id, lang.k AS deriv, lang.s AS sentence"))
def weighted_sample_q(spark, sf):
    s = weighted_sample(_samples(spark, sf), "bool", DEPTH)
    return s.select("sample_id", "deriv", F.array_join("tokens", " ").alias("sentence"))


def sql_flat_bool(e: str) -> str:
    """DuckDB twin of the G2 formula."""
    return (f"list_bool_or(list_transform(string_split({e}, ' or '), lambda t: list_bool_and(list_transform("
            f"string_split(t, ' and '), lambda f: (len(list_filter(string_split(trim(f), ' '), lambda w: w = 'not')) % 2 = 1)"
            f" <> (string_split(trim(f), ' ')[-1] = 'True')))))")


@query("eval_bool_flat", _sampled_sql("bool_simple",
       f"o.o_orderkey AS sample_id, lang.s AS sentence, {sql_flat_bool('lang.s')} AS value"))
def eval_bool_flat(spark, sf):
    s = weighted_sample(_samples(spark, sf), "bool_simple", DEPTH)
    return s.select("sample_id", F.array_join("tokens", " ").alias("sentence"), eval_bool(F.col("tokens")).alias("value"))


_paren_sql = f"""
WITH RECURSIVE sampled AS ({_sampled_sql("bool", "o.o_orderkey AS sample_id, lang.s AS sentence")}),
r(sample_id, sentence, s) AS (
  SELECT sample_id, sentence, sentence FROM sampled
  UNION ALL
  SELECT sample_id, sentence,
         regexp_replace(s, '\\( ([^()]*) \\)',
             CASE WHEN {sql_flat_bool("regexp_extract(s, '\\( ([^()]*) \\)', 1)")} THEN 'True' ELSE 'False' END)
  FROM r WHERE contains(s, '('))
SELECT sample_id, sentence, {sql_flat_bool('s')} AS value FROM r WHERE NOT contains(s, '(')"""


@query("eval_bool_paren", _paren_sql)
def eval_bool_paren(spark, sf):
    s = weighted_sample(_samples(spark, sf), "bool", DEPTH)
    return s.select("sample_id", F.array_join("tokens", " ").alias("sentence"), eval_bool(F.col("tokens")).alias("value"))


def sql_flat_arith(tokens: str) -> str:
    """DuckDB twin of the arithmetic fold on a paren-free token list."""
    step = """lambda st, x: CASE
      WHEN x IN ('+', '-') AND (NOT st.has OR st.mul <> '') THEN
        {'acc': st.acc, 'term': st.term, 'has': st.has, 'mul': st.mul, 'add': st.add,
         'us': st.us * (CASE WHEN x = '-' THEN -1.0 ELSE 1.0 END), 'err': st.err}
      WHEN x IN ('+', '-') THEN
        {'acc': st.acc + st.add * st.term, 'term': 0.0, 'has': false, 'mul': '',
         'add': CASE WHEN x = '-' THEN -1.0 ELSE 1.0 END, 'us': 1.0, 'err': st.err}
      WHEN x IN ('*', '/') THEN
        {'acc': st.acc, 'term': st.term, 'has': st.has, 'mul': x, 'add': st.add, 'us': st.us, 'err': st.err}
      ELSE
        {'acc': st.acc,
         'term': CASE WHEN NOT st.has THEN st.us * TRY_CAST(x AS DOUBLE)
                      WHEN st.mul = '*' THEN st.term * (st.us * TRY_CAST(x AS DOUBLE))
                      WHEN st.mul = '/' THEN CASE WHEN st.us * TRY_CAST(x AS DOUBLE) <> 0
                                                  THEN st.term / (st.us * TRY_CAST(x AS DOUBLE)) END
                      ELSE st.us * TRY_CAST(x AS DOUBLE) END,
         'has': true, 'mul': '', 'add': st.add, 'us': 1.0,
         'err': st.err OR TRY_CAST(x AS DOUBLE) IS NULL OR (st.mul = '/' AND TRY_CAST(x AS DOUBLE) = 0)}
      END"""
    init = "{'acc': 0.0::DOUBLE, 'term': 0.0::DOUBLE, 'has': false, 'mul': '', 'add': 1.0::DOUBLE, 'us': 1.0::DOUBLE, 'err': false}"
    st = f"list_reduce({tokens}, {step}, {init})"
    return f"(CASE WHEN ({st}).err THEN NULL ELSE ({st}).acc + ({st}).add * ({st}).term END)"


def sql_eval_arith(sampled: str, text_col: str = "sentence") -> str:
    """DuckDB: evaluate by rewriting the innermost parenthesis group into its
    value (shortest round-trip text, so exact) until none is left."""
    inner = "regexp_extract(s, '\\( ([^()]*) \\)', 1)"
    return f"""
WITH RECURSIVE sampled AS ({sampled}),
r(sample_id, s) AS (
  SELECT sample_id, {text_col} FROM sampled
  UNION ALL
  SELECT sample_id, regexp_replace(s, '\\( [^()]* \\)',
                                   coalesce(({sql_flat_arith(f"string_split({inner}, ' ')")})::VARCHAR, 'NULL'))
  FROM r WHERE contains(s, '('))
SELECT sampled.*, ({sql_flat_arith("string_split(r.s, ' ')")}) AS v
FROM sampled JOIN r USING (sample_id) WHERE NOT contains(r.s, '(')"""


def _sql_fill(tokens: str, lo: int, hi: int) -> str:
    from .common import sql_draw_int
    key = "'lit:' || o.o_orderkey || ':' || (i - 1)"
    return (f"array_to_string(list_transform({tokens}, lambda t, i: CASE WHEN t = 'NUM' "
            f"THEN ({sql_draw_int(lo, hi, key, inclusive=True)})::VARCHAR ELSE t END), ' ')")


def _arith_sql():
    from .common import sql_signed_log
    filled = _sql_fill("string_split(lang.s, ' ')", -9, 9)
    sampled = _sampled_sql("algebraic_float", f"o.o_orderkey AS sample_id, {filled} AS sentence")
    return f"""SELECT sample_id, sentence, round(v, 6) AS value, round({sql_signed_log('v')}, 6) AS label
FROM ({sql_eval_arith(sampled)})"""


def _var_sql():
    from .common import sql_draw_int, sql_signed_log
    c = sql_draw_int(-9, 9, "'var:' || o.o_orderkey", inclusive=True)
    filled = _sql_fill("string_split(lang.s, ' ')", -9, 9)
    sampled = _sampled_sql("var+algebraic_int",
                           f"o.o_orderkey AS sample_id, 'VAR = ' || ({c}) || ' ; ' || {filled} AS program, "
                           f"replace({filled}, 'VAR', ({c})::VARCHAR) AS body")
    return f"""SELECT sample_id, program, round(v, 6) AS value, round({sql_signed_log('v')}, 6) AS label
FROM ({sql_eval_arith(sampled, 'body')})"""


@query("eval_arith", _arith_sql())
def eval_arith_q(spark, sf):
    """G4+G7 on sampled float-grammar sentences with md5-drawn literals."""
    s = weighted_sample(_samples(spark, sf), "algebraic_float", DEPTH)
    s = s.withColumn("toks", fill_literals(F.col("tokens"), F.col("sample_id"), "int", -9, 9))
    v = eval_arith(F.col("toks"))
    return s.select("sample_id", F.array_join("toks", " ").alias("sentence"), r6(v).alias("value"),
                    r6(signed_log(v)).alias("label"))


@query("eval_var", _var_sql())
def eval_var_q(spark, sf):
    s = weighted_sample(_samples(spark, sf), "var+algebraic_int", DEPTH)
    filled = fill_literals(F.col("tokens"), F.col("sample_id"), "int", -9, 9)
    c = draw_int(-9, 9, "var", F.col("sample_id"), inclusive=True)
    s = s.withColumn("toks", F.concat(F.array(F.lit("VAR"), F.lit("="), c.cast("string"), F.lit(";")), filled))
    v = eval_var(F.col("toks"))
    return s.select("sample_id", F.array_join("toks", " ").alias("program"), r6(v).alias("value"),
                    r6(signed_log(v)).alias("label"))
