"""One registered query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import (
    chat_format,
    decontaminate,
    html_extract,
    language_id,
    lexical_search,
    line_dedup,
    lm_score,
    mixing,
    near_dedup,
    quality_rules,
    spelling,
    substring_dedup,
    token_counts,
)
from tracelode.llm.oracle import SQL

Job = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Share of all tokens each domain of `labels` shall have.
TARGETS = {"clean": 0.9, "poor": 0.06, "toxic": 0.04}


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain: toxic, poor (quality 0) or clean; rows without both marks have none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_digest(_table(spark, sf_dir, "documents"))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_domains(_table(spark, sf_dir, "labels"))
    return mixing.mix(_table(spark, sf_dir, "documents"), labels, TARGETS)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(_table(spark, sf_dir, "documents"))


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold control strings."""
    told = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(told).alias("text"),
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.format_digest(turns.unionByName(extra))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdict_digest(_table(spark, sf_dir, "documents"))


#: Ranks of a public vocabulary, read on the driver, and the id that is free to end a document.
RANK_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END_OF_DOCUMENT = 50256


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and its tokens, counted from the token files that the documents were written to."""
    found = token_counts.document_tokens(_table(spark, sf_dir, "documents"), RANK_FILE, END_OF_DOCUMENT)
    return found.select("doc_id", "n_tokens")


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), width=3, percent=85)


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(_table(spark, sf_dir, "documents"))
    return spelling.group_variants(words)


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(_table(spark, sf_dir, "documents"))
    return lexical_search.search(index, _table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Job] = {
    "op1_substring_dedup": substring,
    "op2_source_mixing": source_mixing,
    "op3_minhash_near_dedup": near,
    "op4_token_counts": tokens,
    "op5_lm_scoring": language_model,
    "op6_chat_formatting": chat_formatting,
    "op7_quality_rules": quality,
    "op8_html_extraction": html_text,
    "op9_benchmark_decontamination": decontamination,
    "op10_line_dedup": lines,
    "op11_language_id": languages,
    "op12_spelling_variants": spelling_variants,
    "op13_ranked_lexical_search": ranked_search,
}

ORACLES: dict[str, str] = dict(SQL)
