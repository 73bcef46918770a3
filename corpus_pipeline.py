"""Corpus cleaning pipeline over ``documents``: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
``documents``; decisions take effect (rejected documents and repeated lines are
gone), and ``n_chars`` follows the text. No SQL expresses the learned stages, so
``ORACLE_SQL`` is None and the stages are tested against brute force.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio.llm import op01_language, op02_lines, op04_pack, op06_rules, op07_similar
from probatio.llm.common import shared_dir, table

#: A document goes if it has no letters or no language explains this share of it.
MIN_SCORE = 0.25
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language; ``lang`` is filled where it is null."""
    found = op01_language.identify(docs.withColumn("__row", F.struct(*COLUMNS)).select(F.col("__row").alias("doc_id"), "text"), op01_language.fit(docs))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return kept.select("doc_id.*", "lang_pred").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned list."""
    rules = op06_rules.fit(docs, table(spark, sf_dir, "labels"))
    return op06_rules.judge(docs, rules).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; documents that lose every line go."""
    kept = op02_lines.dedup_lines(docs)
    kept = kept.where((F.col("n_dropped") == 0) | (F.size("keep_runs") > 0))
    return kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return op07_similar.leaders(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left."""
    return op04_pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
