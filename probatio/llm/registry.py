"""Queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import op02_lines, op09_topk
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("op3_bpe")
def op3(spark, sf_dir):
    import public_tokenizers

    from .op03_tokenize import tokenize

    return tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_packing")
def op4(spark, sf_dir):
    import public_tokenizers

    from .op04_pack import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_token_output")
def op10(spark, sf_dir):
    import public_tokenizers

    from .op10_output import token_output

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_line_dedup", op02_lines.ORACLE)
def op2(spark, sf_dir):
    kept = op02_lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_simhash")
def op7(spark, sf_dir):
    from .op07_simhash import near_groups

    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


@query("op6_quality_rules")
def op6(spark, sf_dir):
    from . import op06_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = op06_rules.fit(docs, table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return op06_rules.judge(docs, rules).select("doc_id", *names)


@query("op1_language_id")
def op1(spark, sf_dir):
    from . import op01_language

    docs = table(spark, sf_dir, "documents")
    found = op01_language.identify(docs, op01_language.fit(docs))
    return found.select("doc_id", op01_language.held_out(), "lang_pred", "score")


@query("op9_top_k", op09_topk.ORACLE)
def op9(spark, sf_dir):
    return op09_topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op5_token_counts")
def op5(spark, sf_dir):
    import public_tokenizers

    from .op05_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_html_extraction")
def op8(spark, sf_dir):
    from .op08_html import extract

    return extract(table(spark, sf_dir, "pages"))
