import json
import os
import tempfile

from pyspark.sql import functions as F

from spanflow.operators.generate import Config, gen_numeric
from spanflow.sources import (prepared, read_code_jsonl, read_code_lines, read_code_tree, read_datasets,
                              read_features, write_dataset, write_features)


def _tmp():
    return tempfile.mkdtemp(prefix="spanflow-test-", dir="/tmp")


def test_jsonl_reader_quarantines_bad_lines(spark):
    d = _tmp()
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write(json.dumps({"language": "java", "code": "int a;"}) + "\n{broken\n")
        f.write(json.dumps({"language": "java", "code": "int a;"}) + "\n")
    df = read_code_jsonl(spark, d).collect()
    assert len(df) == 3 and len({r.doc_id for r in df}) == 3
    assert sum(r._corrupt_record is not None for r in df) == 1


def test_tree_and_line_readers(spark):
    d = _tmp()
    os.makedirs(os.path.join(d, "x", "y"))
    open(os.path.join(d, "x", "A.java"), "w").write("class A {}\n")
    open(os.path.join(d, "x", "y", "B.java"), "w").write("class B {}\nclass C {}\n")
    assert read_code_tree(spark, d, "*.java").count() == 2
    assert read_code_lines(spark, os.path.join(d, "x", "y")).count() == 2


def test_feature_roundtrip(spark):
    d = _tmp()
    rows = [("FooTest", "test", "{}", True, False, True, False, True, False, False)]
    cols = ["class", "method", "code", "hasSwitchStatement", "hasIfStatement", "hasWhileStatement", "hasForLoop",
            "hasFunctionCalls", "throwsException", "catchesException"]
    write_features(spark.createDataFrame(rows, cols), d)
    raw = spark.read.text(d).first()[0]
    assert '"hasSwitchStatement":"true"' in raw
    back = read_features(spark, d).first()
    assert back.hasSwitchStatement is True and back.hasIfStatement is False


def test_dataset_writer_refuses_duplicate_config_and_prepared_skips(spark):
    d = os.path.join(_tmp(), "ds")
    s = spark.range(10).withColumnRenamed("id", "sample_id")
    cfg = Config(0.0, 10.0, 0, 3, "ints", "list_maximum")
    g = gen_numeric(s, cfg).withColumn("task", F.lit(cfg.task)).withColumn("type", F.lit(cfg.type))
    write_dataset(g, d)
    try:
        write_dataset(g, d)
        raise AssertionError("duplicate config accepted")
    except ValueError:
        pass
    p = os.path.join(_tmp(), "prep")
    assert prepared(g, p, ["config_name", "sample_id"]).count() == 10
    assert prepared(g, p, ["config_name", "sample_id"]).count() == 10      # nothing appended twice


def test_dataset_json_reader(spark):
    d = _tmp()
    line = {"config": {"min": 0.0, "max": 10.0, "n": 2, "m": 2, "type": "ints", "task": "list_maximum"},
            "data": [{"language": "java", "inps": ["3", "7"], "outs": [0, 1]},
                     {"language": "java", "inps": ["5", "5"], "outs": [1, 1]}]}
    with open(os.path.join(d, "d.jsonl"), "w") as f:
        f.write(json.dumps(line) + "\n")
    rows = read_datasets(spark, d).orderBy("sample_id").collect()
    assert [r.y_vec for r in rows] == [[0, 1], [1, 1]] and {r.language for r in rows} == {"java"}
    assert rows[0].config_name == "min-0.0-max-10.0-n-2-m-2-type-ints-task-list_maximum"


def test_streaming_featurizer(spark):
    from spanflow.streaming import stream_code_flags
    src, out, ck = _tmp(), _tmp(), _tmp()
    open(os.path.join(src, "A.java"), "w").write("class A { void f() { if (x) { g(); } } }")
    q = stream_code_flags(spark, src, out, ck)
    q.awaitTermination(120)
    r = spark.read.parquet(out).collect()
    assert len(r) == 1 and r[0].HAS_IF and r[0].HAS_INVOKE and not r[0].HAS_WHILE


def test_full_probe_pipeline(spark):
    from spanflow.plans.probe_run import run_probe
    d = _tmp()
    with open(os.path.join(d, "code.jsonl"), "w") as f:
        for i in range(60):
            body = f"if (x > {i}) {{ y = {i}; }}" if i % 2 else f"y = x + {i}; z = y;"
            f.write(json.dumps({"language": "java", "code": f"class C{i} {{ void m() {{ {body} }} }}"}) + "\n")
        f.write(json.dumps({"language": "cobol", "code": "MOVE A TO B."}) + "\n")
        f.write("{not json\n")
    out = os.path.join(_tmp(), "results")
    res, skipped = run_probe(spark, {"input": d, "layers": 2, "out": out})
    assert skipped == 2
    rows = {(r.key, r.layer, r.metric): r.value for r in spark.read.parquet(out).collect()}
    assert ("HAS_IF", 1, "accuracy", ) in {(k, l, m) for k, l, m in rows}
    assert all(0.0 <= v <= 1.0 for (k, l, m), v in rows.items() if m == "accuracy")


def test_comment_stripping(spark):
    from spanflow.functions.lexing import strip_comments
    java = 'int a; // c1\n/* block\n */\nString s = "// not a comment"; int b; /* x */ int c;\n\n'
    py = 'def f():\n    """doc\n    string"""\n    x = "#no"  # yes\n    # only\n    return x\n'
    r = spark.createDataFrame([(java, py)], "j string, p string").select(
        strip_comments(F.col("j"), "java").alias("j"), strip_comments(F.col("p"), "python").alias("p")).first()
    assert r.j == 'int a;  \nString s = "// not a comment"; int b;   int c;'
    assert r.p == 'def f():\n    x = "#no"  \n    return x'


def test_method_features_roundtrip(spark):
    from spanflow.operators.structure import method_features
    code = "class FooTest {\n  public void test() { while (x) { f(); } }\n  int g() throws E { return 1; }\n}"
    docs = spark.createDataFrame([(1, code)], "doc_id long, text string")
    rows = {r.method: r for r in method_features(docs).collect()}
    assert rows["test"].code == "public void test() { while (x) { f(); } }"
    assert rows["test"].hasWhileStatement and rows["test"].hasFunctionCalls and rows["g"].throwsException
    d = _tmp()
    write_features(method_features(docs).drop("doc_id"), d)
    back = {r.method: r for r in read_features(spark, d).collect()}
    assert back["g"].throwsException is True and back["g"].hasWhileStatement is False
