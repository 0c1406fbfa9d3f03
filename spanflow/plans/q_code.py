"""Queries on source code: document and method flags, literal labels, comments.

The code is a template over customers: every part is in a customer's file if
the key is divisible by the part's number.  The SQL twins know the answers from
the key and the template alone; they read no code.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import functions as F

from ..functions.lexing import strip_comments
from ..operators.structure import DOC_FLAGS, METHOD_FLAGS, code_flags_rows, method_rows_of
from ..operators.tokens import label_tokens, token_table
from .common import T, sql_str
from .registry import query


class Part(NamedTuple):
    code: str
    doc: str = ""         # document flags it raises
    method: str = ""      # method flags it raises
    labels: str = ""      # literals and types in it


#: Stands for a literal of 2,000 to 2,999 characters.
LONG = "\0"
PARTS = [
    Part("if (a > g(b)) { i = 0x1F; }", "HAS_IF HAS_INVOKE", "hasIfStatement hasFunctionCalls", "hex_integer_literal"),
    Part(f'while (true) {{ s = "{LONG}"; }}', "HAS_WHILE", "hasWhileStatement", "string_literal true"),
    Part("for (int j = 0777; j < 1_000; j++) { }", "HAS_FOR", "hasForLoop", "octal_integer_literal decimal_integer_literal"),
    Part("switch (k) { case 0b101: break; }", "HAS_SWITCH", "hasSwitchStatement", "binary_integer_literal"),
    Part("try { p.q.r(1.5f); } catch (E e) { }", "HAS_TRY_CATCH HAS_INVOKE", "hasFunctionCalls catchesException",
         "decimal_floating_point_literal"),
    Part('throw new a.b.E("if (x)");', "HAS_THROW", "", "string_literal"),
    Part("do { c = '\\''; } while (a);", "", "", "character_literal"),
    Part("Object o = new java.util.ArrayList(null); // for (;;) f();\n", "", "", "null_literal"),
    Part('new B<C>().d("\\"if");', "HAS_INVOKE", "hasFunctionCalls", "string_literal"),
    Part("Runnable r = new Runnable() { public void run() { if (z) { go(); } } };", "HAS_IF HAS_INVOKE",
         "hasIfStatement hasFunctionCalls", "void_type"),
    Part('String t = """\nif (x) { foo(); } "" \\""" while (y)\n""";', "", "", "string_literal"),
    Part("do if (a) i = 1; while (b);", "HAS_IF", "hasIfStatement", "decimal_integer_literal"),
    Part("class L { void inner() { h(); } int k; } for (;;) { }", "HAS_INVOKE HAS_FOR", "hasFunctionCalls hasForLoop", "void_type"),
]
# class, method, code before and after its parts, whether it throws
METHODS = [
    ("A", "m0", '/* if (x) { */\n@SuppressWarnings({"a", "while (b)"})\npublic abstract class A extends B<C> {\n'
                "  Runnable f = new Runnable() { public void run() { } };\n  A() { }\n  @Test(timeout=5) public void m0() {\n", "}\n", False),
    ("A", "m1", "  List<String> m1(int a) throws E {\n", "}\n", True),
    ("A", "m2", "  abstract boolean m2(int a);\n}\n", None, False),
    ("D", "m3", "class D {\n  D() { }\n  int m3() {\n", "}\n", False),
    ("P", "m4", "record P(int x, List<A> y) {\n  P { }\n  int m4() throws E {\n", "}\n}\n}\n", True),
]
BASE_LABELS = "string_literal string_literal void_type void_type decimal_integer_literal boolean_type"
DIVISORS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14)
LABELS = sorted({x for p in PARTS for x in p.labels.split()} | set(BASE_LABELS.split()))


def chosen() -> list[tuple[int, int, Part]]:
    """(method, divisor, part): each method deals the divisors out anew."""
    return [(m, DIVISORS[(i + 3 * m) % len(DIVISORS)], p)
            for m, (_, _, _, end, _) in enumerate(METHODS) if end is not None for i, p in enumerate(PARTS)]


def _filled(code: str):
    own = [F.lit(x) for x in code.split(LONG)]
    blob = F.expr("repeat('x', CAST(2000 + c_custkey % 1000 AS INT))")
    return F.concat(*[x for i, o in enumerate(own) for x in ((o, blob) if i < len(own) - 1 else (o,))])


def _if_divides(divisor: int, value, other):
    return F.when(F.col("c_custkey") % divisor == 0, value).otherwise(other)


def java_files(spark, sf, partitioned=False):
    """One Java file per customer; ``partitioned``: the keys are dealt out by their hash and sorted before texts are made, so that
    the files of a key come one after another and no text is shuffled."""
    out = []
    for m, (_, _, begin, end, _) in enumerate(METHODS):
        out.append(F.lit(begin))
        if end is not None:
            out += [_if_divides(d, _filled(p.code), F.lit("")) for mm, d, p in chosen() if mm == m] + [F.lit(end)]
    d = T(spark, sf, "customer").select("c_custkey")
    if partitioned:
        d = d.where("c_custkey IS NOT NULL").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey").sortWithinPartitions("c_custkey")
    return d.select(F.col("c_custkey").alias("doc_id"), F.concat(*out).alias("text"))


def java_tokens(spark, sf):
    return token_table(java_files(spark, sf), lang="java", with_label=True, with_lines=False)


def _divides(divisors: list[int]) -> str:
    return " OR ".join(f"c_custkey % {d} = 0" for d in divisors) or "false"


def _raised(flag: str, field: str, method: int | None = None) -> str:
    return _divides(sorted({d for m, d, p in chosen() if flag in getattr(p, field).split() and method in (None, m)}))


@query("code_flags", "SELECT c_custkey AS doc_id, " + ", ".join(f"({_raised(f, 'doc')}) AS {f}" for f in DOC_FLAGS) + " FROM customer")
def code_flags_query(spark, sf):
    return code_flags_rows(java_files(spark, sf, partitioned=True), partitioned=True).select("doc_id", *DOC_FLAGS)


def _method_sql(m: int) -> str:
    cls, name, _, _, throws = METHODS[m]
    cols = [f"({str(throws).lower() if f == 'throwsException' else _raised(f, 'method', m)}) AS {f}" for f in METHOD_FLAGS]
    return f"SELECT c_custkey AS doc_id, '{cls}' AS class, '{name}' AS method, {', '.join(cols)} FROM customer"


@query("method_flags", " UNION ALL ".join(_method_sql(m) for m in range(len(METHODS))))
def method_flags_query(spark, sf):
    return method_rows_of(java_files(spark, sf, partitioned=True), partitioned=True).select("doc_id", "class", "method", *METHOD_FLAGS)


def _label_count(label: str) -> str:
    terms = [f"{p.labels.split().count(label)} * (c_custkey % {d} = 0)::BIGINT" for _, d, p in chosen() if label in p.labels.split()]
    return " + ".join([f"{BASE_LABELS.split().count(label)}::BIGINT", *terms])


@query("java_labels", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT c_custkey AS doc_id, {sql_str(x)} AS label, {_label_count(x)} AS n FROM customer" for x in LABELS) + ") WHERE n > 0")
def java_labels_query(spark, sf):
    t = label_tokens(java_tokens(spark, sf))
    return t.filter(F.col("label").isin(LABELS)).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


#: Code and what is left of it without comments (None: nothing, the line goes).
JAVA_LINES = [("/* block\n of two */ int a = 1;", "  int a = 1;"), ('String s = "// no /* no */"; // yes', 'String s = "// no /* no */";  '),
              ("\t", None), ("char c = '\"'; /* it's */", "char c = '\"';  "), ("// only", None),
              ("int b /* x */ = /**/ 2;", "int b   =   2;"), (f'f("{LONG}//");', f'f("{LONG}//");'),
              (f"/* {LONG} */", None), ("}", "}")]
PYTHON_LINES = [("x = 1  # c", "x = 1  "), ('"""doc\n# no"""', None), ('s = """a # no\nb"""', 's = """a # no\nb"""'), (" \t", None),
                ("t = '#'  # yes", "t = '#'  "), ("# only", None), (f'u = "{LONG}#"', f'u = "{LONG}#"'), (f"# {LONG}", None),
                ("def f(): return 'it\\'s # no'", "def f(): return 'it\\'s # no'")]


def _commented(spark, sf, lines, lang):
    parts = [_if_divides(DIVISORS[i], _filled(code), F.lit(None)) for i, (code, _) in enumerate(lines)]
    d = T(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat_ws("\n", *parts).alias("code"))
    left = strip_comments(F.col("code"), lang)
    return d.select("doc_id", F.length("code").cast("long").alias("len_before"), F.length(left).cast("long").alias("len_after"),
                    F.md5(left.cast("binary")).alias("digest"))


def _commented_sql(lines) -> str:
    def text(code):
        return "concat(" + ", repeat('x', 2000 + c_custkey % 1000), ".join(sql_str(x) for x in code.split(LONG)) + ")"
    before = ", ".join(f"CASE WHEN c_custkey % {DIVISORS[i]} = 0 THEN {text(c)} END" for i, (c, _) in enumerate(lines))
    after = ", ".join(f"CASE WHEN c_custkey % {DIVISORS[i]} = 0 THEN {text(c)} END" for i, (_, c) in enumerate(lines) if c is not None)
    return f"""SELECT doc_id, length(b) AS len_before, length(a) AS len_after, md5(a) AS digest
FROM (SELECT c_custkey AS doc_id, concat_ws(chr(10), {before}) AS b, concat_ws(chr(10), {after}) AS a FROM customer)"""


@query("comments_java", _commented_sql(JAVA_LINES))
def comments_java(spark, sf):
    return _commented(spark, sf, JAVA_LINES, "java")


@query("comments_python", _commented_sql(PYTHON_LINES))
def comments_python(spark, sf):
    return _commented(spark, sf, PYTHON_LINES, "python")
