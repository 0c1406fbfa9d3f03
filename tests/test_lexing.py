"""Lexers on long literals, number and type labels, comments inside literals,
config keys, idempotent results, NULL keys in scans."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from spanflow.functions.lexing import pieces, strip_comments, token_label

LONG = {"literal": 'x = "' + "a" * 1_000_000 + '";', "escapes": '"' + "\\n" * 500_000 + '"',
        "comment": "/*" + "b\n" * 500_000 + "*/ z", "char": "'" + "\\\\" * 500_000 + "'"}
LABELS = {"1_000": "decimal_integer_literal", "0b101": "binary_integer_literal", "0777": "octal_integer_literal",
          "0": "decimal_integer_literal", "0x1F": "hex_integer_literal", "void": "void_type", "boolean": "boolean_type",
          "int": "int", "1.5f": "decimal_floating_point_literal"}


@pytest.mark.parametrize("lang", ["java", "python"])
def test_long_literals_do_not_use_up_the_stack(spark, lang):
    d = spark.createDataFrame(list(LONG.items()), "name string, t string")
    rows = d.select("t", F.array_join(pieces(F.col("t"), lang), "").alias("back"), strip_comments(F.col("t"), lang).alias("s")).collect()
    assert all(r.t == r.back and r.s is not None for r in rows)


def test_number_and_type_labels(spark):
    d = spark.createDataFrame(list(LABELS.items()), "t string, label string")
    assert [r.t for r in d.where(token_label(F.col("t")) != F.col("label")).collect()] == []


def test_comments_inside_literals_and_tab_lines(spark):
    cases = [("java", "int a;\n\t\nint b; /* c */'x'", "int a;\nint b;  'x'"),
             ("python", 's = """a # no\nb"""\n\t\nt = 1  # yes', 's = """a # no\nb"""\nt = 1  ')]
    for lang, code, out in cases:
        d = spark.createDataFrame([(code,)], "c string")
        assert d.select(strip_comments(F.col("c"), lang)).first()[0] == out


def test_config_keys_have_one_spelling(spark):
    from spanflow.functions.scalars import config_name
    from spanflow.operators.generate import Config
    for lo, hi in ((1e-4, 1e7), (0.0, 10.0), (-2.5e-9, 123456789.5)):
        d = spark.createDataFrame([(lo, hi, 2, 3, "floats", "list_maximum")], "a double, b double, n int, m int, t string, k string")
        assert d.select(config_name("a", "b", "n", "m", "t", "k")).first()[0] == Config(lo, hi, 2, 3, "floats", "list_maximum").name


def test_results_are_written_once(spark):
    from spanflow.sources.sinks import write_results
    path = os.path.join(tempfile.mkdtemp(), "results")
    d = spark.createDataFrame([("k", 1, "accuracy", 0.5), ("k", 2, "accuracy", 0.7)], "key string, layer int, metric string, value double")
    write_results(d, path)
    write_results(d, path)
    assert spark.read.parquet(path).count() == 2


def test_scans_keep_null_keys(spark):
    from spanflow.operators.lists import group_max_flags
    from spanflow.operators.scan import group_positions, last_before
    d = spark.createDataFrame([(None, 1, 1, "a"), (None, 2, None, "b"), (1, 1, 1, "c"), (1, 2, 2, None)],
                              "k int, o int, c int, v string")
    assert group_positions(d, ["k"], ["o"], chunk="c").count() == 4
    assert last_before(d, ["k"], ["o"], "v", "before", chunk="c").count() == 4
    assert group_max_flags(d, ["k"], "o").count() == 4
