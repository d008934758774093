"""Corpus pipeline: quality rules, near duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but the
last return the columns of documents. Nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import bpe, decontaminate, ngram_join, pii, quality_rules
from routeloom.llm.common import Scratch, prepare


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the repetition verdict go."""
    prepare(spark)
    return quality_rules.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near duplicates stays: five words, 0.8."""
    prepare(spark)
    return ngram_join.keep_one(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_leaks(docs, items)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; no document goes."""
    prepare(spark)
    return pii.mask_pii(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding gives the text back."""
    prepare(spark)
    return bpe.tokens_of(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again by the next."""
    scratch = Scratch(prepare(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(name, docs)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
