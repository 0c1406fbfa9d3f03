"""M6: the full probing pipelines as one function.

Task ``structure``: load code (S1) -> quarantine bad rows (P2, P6) -> tokens (C1, C2) -> targets
= structure flags (C3) -> vectors (V1, per layer) -> split (L6) -> drop
constant targets (P7) -> one probe per (target, layer) (M1, M5) -> long
results (K3).

Task ``numeracy``: load generated datasets (S2) -> leave out configs whose results are stored (J1) and
unusable samples (P6) -> tokens, aligned means, flattened inputs (J2, A4, V3, F10, F11) -> split (L6) -> a probe a (config,
layer) (M2-M4) -> long results (K3), stored by config, so that a run that was broken off goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_split
from ..operators.kernel import pending, quarantine
from ..operators.numeric import numeric_probes, usable
from ..operators.solver import logistic_probes
from ..operators.structure import DOC_FLAGS, code_flags
from ..operators.tokens import token_table
from ..operators.vectors import hash_ngram_vectors
from ..sources.sinks import stored_results, write_results
from ..sources.tables import read_code_jsonl, read_datasets

DEFAULTS = {"task": "structure", "langs": ["java"], "layers": 3, "dims": 16, "out": None, "lang": "prose"}


def run_probe(spark: SparkSession, spec: dict) -> tuple[DataFrame, int]:
    """Run the pipeline described by ``spec`` (keys: ``task``; ``input`` = JSONL path
    or a DataFrame: ``(doc_id, language, code)`` for structure, dataset rows as the generators make them for numeracy; optional
    ``langs``, ``layers``, ``dims``, ``out``, and for numeracy ``lang``, the lexer).  Returns the results
    table and the number of skipped rows.  Whole texts are processed."""
    spec = {**DEFAULTS, **spec}
    if spec["task"] == "numeracy":
        return _numeracy(spark, spec)
    if spec["task"] != "structure":
        raise ValueError(f"unknown task {spec['task']}")
    src = spec["input"]
    docs = read_code_jsonl(spark, src) if isinstance(src, str) else src.withColumn("_corrupt_record", F.lit(None).cast("string"))
    err = (F.when(F.col("_corrupt_record").isNotNull(), "malformed line")
            .when(F.col("code").isNull(), "no code")
            .when(~F.col("language").isin(spec["langs"]), "unsupported language"))
    ok, bad = quarantine(docs, err)
    n_skipped = bad.count()
    toks = token_table(ok.select("doc_id", F.col("code").alias("text")), lang="java", with_label=True)
    flags = code_flags(toks).withColumn("split", hash_split("doc_id"))
    vecs = hash_ngram_vectors(toks, ["doc_id"], dims=spec["dims"], layers=spec["layers"])
    samples = vecs.join(flags, "doc_id").select(
        "layer", "split", F.col("vec").alias("x"), F.array(*[F.col(f).cast("int") for f in DOC_FLAGS]).alias("ys"))
    res = logistic_probes(samples, list(DOC_FLAGS))
    if spec["out"]:
        write_results(res, spec["out"])
    return res, n_skipped


def _numeracy(spark: SparkSession, spec: dict) -> tuple[DataFrame, int]:
    """Results of all configs of the input, those stored before included; the skipped samples are those of this run."""
    src, out = spec["input"], spec["out"]
    samples = read_datasets(spark, src) if isinstance(src, str) else src
    old = stored_results(spark, out) if out else None
    if old is not None:
        samples = pending(samples, old.select(F.col("key").cast("string").alias("config_name")), ["config_name"])
    facts = samples.groupBy("task").agg(F.count_if(~usable()).alias("skipped"), F.count_if(usable()).alias("used")).collect()   # one row a task
    tasks, n_skipped = [r.task for r in facts if r.used], sum(r.skipped for r in facts)
    if not tasks:
        return (old if old is not None else spark.createDataFrame([], "key string, layer int, metric string, value double")), n_skipped
    res = numeric_probes(samples, tasks, spec["lang"], spec["layers"], spec["dims"])
    if not out:
        return res, n_skipped
    write_results(res, out)
    return stored_results(spark, out), n_skipped
