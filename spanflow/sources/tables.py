"""Sources (S1-S5) and the test-table loader.  All readers use explicit
schemas: no inference pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables (parquet); column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: load(spark, sf_dir, t) for t in TABLES}


CODE_SCHEMA = T.StructType([
    T.StructField("language", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_code_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSONL of ``{language, code}``.  Malformed lines are kept with the raw
    text in ``_corrupt_record`` (P6 quarantines them) instead of failing the job.
    ``doc_id`` is unique per line (two identical lines stay two records) and
    stable for a given file layout, also when a lost task is recomputed
    (split index and position in the split)."""
    df = (spark.read.schema(CODE_SCHEMA)
          .option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record")
          .json(path))
    return df.select(
        F.monotonically_increasing_id().alias("doc_id"),
        "language", "code", "_corrupt_record",
        F.col("_metadata.file_path").alias("file_path"))


def read_code_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """S3: every regular file under ``root`` (recursively) is one document."""
    r = spark.read.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.text(root, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("file_path"),
                     F.col("value").alias("code"))


def read_code_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line-wise scan, one class per line.  A splittable text scan has
    no line number; the key is unique per line and stable for a file layout."""
    df = spark.read.text(path)
    return df.select(F.col("_metadata.file_path").alias("file_path"),
                     F.monotonically_increasing_id().alias("line_key"),
                     F.col("value").alias("code"))


METHOD_FLAGS = ("hasSwitchStatement", "hasIfStatement", "hasWhileStatement", "hasForLoop",
                "hasFunctionCalls", "throwsException", "catchesException")

FEATURE_SCHEMA = T.StructType(
    [T.StructField("class", T.StringType()), T.StructField("method", T.StringType()),
     T.StructField("code", T.StringType())]
    + [T.StructField(f, T.StringType()) for f in METHOD_FLAGS])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Method-feature JSONL; the string booleans become real booleans."""
    df = spark.read.schema(FEATURE_SCHEMA).json(path)
    return df.select("class", "method", "code",
                     *[(F.lower(F.col(f)) == "true").alias(f) for f in METHOD_FLAGS])


CONFIG_SCHEMA = T.StructType([
    T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()),
    T.StructField("n", T.LongType()), T.StructField("m", T.LongType()),
    T.StructField("type", T.StringType()), T.StructField("task", T.StringType()),
])

DATASET_SCHEMA = T.StructType([
    T.StructField("config", CONFIG_SCHEMA),
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("language", T.StringType()),
        T.StructField("inps", T.ArrayType(T.StringType())),
        T.StructField("outs", T.StringType()),   # variant by task; typed below
    ]))),
])


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """Dataset files written one line per config (the reference layout).
    The payload array is exploded to one row per sample, ``outs`` kept as JSON
    text and parsed into the typed label columns."""
    from ..functions.scalars import config_name
    df = spark.read.schema(DATASET_SCHEMA).option("primitivesAsString", "true").json(path)
    ex = df.select("config", F.posexplode("data").alias("sample_id", "s"))
    outs = F.col("s.outs")
    return ex.select(
        config_name(*[F.col(f"config.{c}") for c in ("min", "max", "n", "m", "type", "task")]).alias("config_name"),
        F.col("config.*"),
        F.col("sample_id").cast("long"),
        F.col("s.language").alias("language"),
        F.col("s.inps").alias("inps"),
        F.when(outs.startswith("["), F.from_json(outs, "array<int>")).alias("y_vec"),
        outs.try_cast("double").alias("y_num"),
        F.when(F.lower(outs).isin("true", "false"), F.lower(outs) == "true").alias("y_bool"),
        F.when(outs.startswith("["), F.from_json(F.lower(outs), "array<boolean>")).alias("y_bools"),
    )
