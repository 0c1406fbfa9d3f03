"""Corpus pipeline: quality rules, line dedup, near duplicates, benchmark
decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.

Defined cases: documents with NULL or empty texts are rejected by the quality
rules; rows of equal id and text are treated alike by every stage, and of those with
words one is left by the near-duplicate stage, which also takes rows without an id
as copies; an empty table gives an empty packing; further columns are carried up to the packing,
whose rows hold doc_id and the piece columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanflow.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from spanflow.llm.common import quoted, stored, table

#: The packing and the texts before it are outside what SQL expresses (token
#: ids): tests hold every stage against brute force instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted from the texts: two lines or more, or
    one of 8 words or more."""
    rows = line_dedup.dedup_lines(docs, single=line_dedup.SINGLE)
    n = F.length("text").cast("bigint")
    return rows.select(*[n.alias(c) if c == "n_chars" else quoted(c) for c in rows.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with 80 % of their 5-word shingles in common one
    stays (op8's limits, 90 % of 3-word shingles, are that query's own)."""
    return jaccard_join.keep_one(docs, k=5, percent=80, keep_nulls=False)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 5 % or more of their words in benchmark windows go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that are left, packed into sequences."""
    return packing.pack(docs, keep=["doc_id"])


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicates),
          ("benchmark_decontamination", benchmark_decontamination), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
