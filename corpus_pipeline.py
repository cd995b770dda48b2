"""A cleaning run over a corpus: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. `run` writes every stage's result to the shared folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules
from tracelode.llm.queries import TARGETS, label_domains
from tracelode.session import cut_lineage


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines removed; documents that the rules reject go."""
    return quality_rules.clean(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines removed."""
    return line_dedup.deduplicate(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays."""
    return near_dedup.one_of_each(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampling rate of every document left: doc_id, n_rows, n_tokens, domain posteriors, rate."""
    labels = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(docs, labels, TARGETS)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("line dedup", remove_repeated_lines),
    ("near dedup", keep_one_of_each),
    ("decontamination", remove_leaks),
    ("mixing", mix_to_targets),
]

#: The mixing stage is iterative; tests/llm holds the run against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
