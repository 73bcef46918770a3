"""Readers of code corpora: every one gives ``sample_id`` and ``code``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio.operators.corpus import patch_code

GENERATED = "problem_id string, code string, should_be_rejected boolean, failure_category string, difficulty_level string, source string"
PATCHES = "instance_id string, repo string, problem_statement string, patch string, base_commit string, test_patch string, created_at string, hints_text string, version string"
EVALUATION = "metadata struct<total:long>, metrics struct<accuracy:double,tpr:double,fpr:double>, detailed_results array<struct<problem_id:string,category:string,should_reject:boolean,verdict:string,score:double,correct:boolean>>"


def one_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("sample_id"), F.col("value").alias("code"))


def directory(spark: SparkSession, path: str, pattern: str = "*.py") -> DataFrame:
    """All files below ``path`` whose names match, keyed by their full paths."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("sample_id"), F.col("value").alias("code"))


def rows(spark: SparkSession, samples: list[tuple[str, str, dict | None]]) -> DataFrame:
    """In-memory samples of (id, code, context)."""
    df = spark.createDataFrame(samples, "sample_id string, code string, context map<string,string>")
    flags = [F.coalesce(F.lower(F.try_element_at("context", F.lit(k))), F.lit("")) for k in ("swe_bench_sample", "github_issue")]
    return df.withColumn("is_patch_context", ~flags[0].isin("", "false", "0", "none") | ~flags[1].isin("", "false", "0", "none"))


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan dealt over all cores if it has less than two splits a core.

    Splits of a small file may be empty, as a row group is read by one of them
    only. Large tables have splits enough, and their text is not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * cores) if not scan.isStreaming and scan.rdd.getNumPartitions() < 2 * cores else scan


def table(df: DataFrame, key: str, text: str) -> DataFrame:
    """A table's text column as samples."""
    return spread(df).select(F.col(key).alias("sample_id"), F.col(text).alias("code"))


def patches(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Public benchmark rows (JSON or Parquet) that hold a statement and a patch, as samples."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(PATCHES).json(path)
    held = raw.where((F.coalesce("problem_statement", F.lit("")) != "") & (F.coalesce("patch", F.lit("")) != ""))
    held = held if most is None else held.orderBy("instance_id").limit(most)
    return held.select(F.col("instance_id").alias("sample_id"), patch_code(F.col("patch")).alias("code"), F.lit(True).alias("is_patch_context"), "repo", "problem_statement")


def generated(spark: SparkSession, path: str) -> DataFrame:
    """Generated labelled samples; missing fields take their defaults."""
    raw = spark.read.schema(GENERATED).option("multiLine", True).json(path)
    return raw.select(
        F.col("problem_id").alias("sample_id"), "code", F.coalesce("should_be_rejected", F.lit(True)).alias("should_reject"),
        F.coalesce("failure_category", F.lit("unknown")).alias("category"), F.coalesce("difficulty_level", F.lit("medium")).alias("difficulty"), F.coalesce("source", F.lit("generated")).alias("source"),
    )


def evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of stored evaluation files."""
    raw = spark.read.schema(EVALUATION).option("multiLine", True).json(path)
    return raw.select("metrics.*", F.explode("detailed_results").alias("r")).select("accuracy", "tpr", "fpr", "r.*")


def templated(n: int, spark: SparkSession) -> DataFrame:
    """Good and bad samples made by a template: every third is bad."""
    bad = F.format_string("def job_%d(value):\n    return eval(value)\n", "id")
    good = F.format_string('def job_%d(value):\n    """Return the value or zero."""\n    if value is None:\n        return 0\n    return value\n', "id")
    return spark.range(n).select(F.format_string("t-%05d", "id").alias("sample_id"), F.when(F.col("id") % 3 == 0, bad).otherwise(good).alias("code"), (F.col("id") % 3 == 0).alias("should_reject"))
