"""Flags of whole Java texts against those of their token tables."""

import random

import pytest
from test_structure import CALLS, METHODS, SNIPPETS

from spanflow.operators.structure import code_flags, code_flags_rows, method_rows, method_rows_of
from spanflow.operators.tokens import token_table

# --- fixed values -----------------------------------------------------------
WORDS = ("class interface record enum { { { } } } ( ( ) ) ; ; , = -> . @ new if while do for switch try throw throws catch void int "
         "A B f g h [ ] < > >> 1 09L \"s\" 'c' // é ² null public").split()
PARTS = ["class A {", "record R(int x) {", "enum E { P(1);", "void f() {", "int g(int a) throws E {", "A() {", "Runnable r = new Runnable() {",
         "class L {", "do {", "} while (a);", "do x(); while (b);", "int k = f(1);", "@T(x = 1)", "h();", "if (a) {", "while (b) {", "}", "}", "}",
         "f(new a.B<C>().d(), x -> { y(); });", "int[] z = {1, 2};", "/* if (x) { */", "// {\n", "abstract boolean m();", "new int[] {f()};"]
# ---------------------------------------------------------------------------


def _texts(n=400, seed=7):
    r = random.Random(seed)
    texts = [" ".join(r.choice(WORDS) + ("\n" if r.random() < .1 else "") for _ in range(r.randint(0, 60))) for _ in range(n)]
    texts += ["class T { " + " ".join(r.choice(PARTS) for _ in range(r.randint(1, 25))) for _ in range(n)]
    return [*texts, *SNIPPETS.values(), *[c for c, _ in CALLS + METHODS], "", None, " \n", "// only"]


def _both(spark, rows, of_tokens, of_texts):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = token_table(docs, lang="java", with_label=True)
    a, b = of_tokens(tokens), of_texts(docs)
    assert a.schema.simpleString() == b.schema.simpleString()
    return sorted(map(str, a.collect())), sorted(map(str, b.collect()))


@pytest.mark.parametrize("pair", [(code_flags, code_flags_rows), (method_rows, method_rows_of)])
def test_walk_of_texts_is_that_of_token_tables(spark, pair):
    # rows of one id are one document, piece by piece; none without an id
    rows = list(enumerate(_texts()))
    a, b = _both(spark, rows + rows[::7] + [(None, SNIPPETS["if"])], *pair)
    assert a == b and len(a) > 100


@pytest.mark.parametrize("name", ["code_flags", "method_flags"])
def test_no_token_is_a_row(spark, tmp_path, name):
    import __spark_entry__
    spark.createDataFrame([(i,) for i in range(1, 61)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("Exchange") == 1
    assert df.count() == (60 if name == "code_flags" else 300)
