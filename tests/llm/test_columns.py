"""Columns whose names hold dots or are those of results, in every operator on texts and every stage."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanflow.llm import decontaminate, langid, license, packing, quality

PROSE = " ".join(f"Word{i} and more{i % 7} of it" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{PROSE} tail{i}" if i % 3 else None, "en" if i % 2 else "de", "s", 5, i, "k", "h", "w", "c") for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `x.y` int, own0 string, hit_runs string, "
                                       "n_words string, in0 string")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "word3 and more3")], "item_id long, text string")


def test_operators_carry_them(docs, bench):
    for out in (license.scan(docs), packing.pack(docs), decontaminate.mark(docs, bench), langid.identify(docs), quality.ledger(docs)):
        assert "x.y" in out.columns and "own0" in out.columns
        assert {r["x.y"] for r in out.select(F.col("`x.y`")).collect()} <= set(range(12)) and out.count() >= 12
    spans = decontaminate.remove_spans(docs, bench)
    assert spans.columns == docs.columns and {(r.hit_runs, r.n_words) for r in spans.collect()} == {("h", "w")}
    assert "Word3 and" not in spans.where("doc_id = 1").first().text


@pytest.mark.parametrize("at", range(4))
def test_stages_carry_them(spark, docs, tmp_path, at):
    spark.createDataFrame([(1, "word3 and more3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    kept = out.collect()
    assert {r.hit_runs for r in kept} <= {"h"} and {r["x.y"] for r in kept} <= set(range(12)), name
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert stage(spark, docs.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema]), str(tmp_path)).columns == docs.columns
