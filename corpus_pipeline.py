"""The corpus pipeline: stages of the training-data operators over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import language, minhash, packing, quality, secrets
from emberline.llm.queries import table, tokenizer
from emberline.session import store


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that their labelled neighbours vote against (operator 7)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language (operator 8)."""
    return language.keep_identified(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (operator 2)."""
    return minhash.keep_distinct(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces credentials in the texts by their kind (operator 4)."""
    return secrets.redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the kept documents into sequences (operator 9), beside what earlier stages have left in memory."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), cache=60_000, rows=500)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("MinHash near-dedup", minhash_near_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Trained models and tokenisers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
