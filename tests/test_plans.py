"""Plan properties that the scale design depends on (regression guards)."""
import re

import pytest

from spanflow.plans.registry import load_all_plans

SF = "/root/testdata/sf0.001"
Q, _ = load_all_plans()
FITTING = {"probe_addition"}   # fits while planning
PROBES = {"probe_logistic", "probe_summary", "probe_multi", "probe_scores"}   # long plans, run in test_queries


def _plan(spark, name, run=False):
    df = Q[name](spark, SF)
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(plan):
    return len(re.findall(r"Exchange (hash|range|Single|Round)", plan))


@pytest.mark.parametrize("name", sorted(n for n in Q if n not in FITTING | PROBES))
def test_no_cartesian_or_nested_loop_join(spark, name):
    p = _plan(spark, name)
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["token_spans", "token_labels", "line_offsets", "named_tokens", "align_tokens", "token_piece_vectors"])
def test_token_queries_shuffle_no_token_rows(spark, name):
    p = _plan(spark, name)
    # the one exchange deals out the documents of a file of one split, or counts by document
    assert _exchanges(p) == 1 and "Sort" not in p and "Join" not in p
    assert name == "named_tokens" or "Exchange RoundRobin" in p


@pytest.mark.parametrize("name", ["wrap_text", "span_text", "strip_comments", "signed_log", "argmax_onehot",
                                  "gen_decoding", "gen_compare", "weighted_sample", "eval_arith"])
def test_row_level_queries_do_not_shuffle(spark, name):
    assert _exchanges(_plan(spark, name)) == 0


def test_tokens_of_many_splits_are_not_shuffled(spark):
    from pyspark.sql import functions as F

    from spanflow.operators.rowspans import aligned, lines, tokens
    docs = spark.range(100, numPartitions=64).select(F.col("id").alias("doc_id"), F.format_string("text %s, and\nmore", "id").alias("text"))
    for made in (tokens(docs, with_label=True), lines(docs), aligned(docs, with_texts=True)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString() and made.count() >= 200


def test_grammar_samples_are_unranked_without_a_join(spark):
    import pytest

    from spanflow.operators.grammar import counts, weighted_sample
    ids = spark.range(50).withColumnRenamed("id", "sample_id")
    for depth in (5, 6):
        d = weighted_sample(ids, "bool", depth)
        assert "Join" not in d._jdf.queryExecution().executedPlan().toString()
        rows = d.collect()
        assert all(0 <= r.deriv < counts("bool", depth)[depth] and r.tokens for r in rows)
    with pytest.raises(ValueError):
        weighted_sample(ids, "bool", 9)


def test_bucketed_documents_remove_the_shuffle(spark):
    import tempfile

    from spanflow.operators.tokens import token_table
    from spanflow.sources import bucketed_documents
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    path = tempfile.mkdtemp(prefix="spanflow-bucketed-", dir="/tmp")
    b = bucketed_documents(docs, "docs_bucketed_test", path, 4)
    tok = token_table(b, with_lines=False, partitioned=True)
    p = tok._jdf.queryExecution().executedPlan().toString()
    assert _exchanges(p) == 0
    ref = token_table(docs, with_lines=False)
    assert tok.exceptAll(ref).count() == 0 and ref.exceptAll(tok).count() == 0
