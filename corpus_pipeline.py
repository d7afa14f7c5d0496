"""The corpus pipeline: five stages over the documents table, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbank.llm import bpe, decontam, line_dedup, minmax_dedup, quality
from quillbank.llm.shared import cut, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; each row is judged by its own text, with or without a doc_id."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share are dropped; n_chars follows the text."""
    return _recounted(line_dedup.line_dedup(docs), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in 0.8 of their five-word shingles the one of least doc_id stays."""
    return minmax_dedup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others the words of benchmark windows are cut; n_chars follows the text."""
    return _recounted(decontam.decontaminate(docs, read(spark, sf_dir, "benchmark")), docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, and n_tokens, ids_sha256 and decoded_sha256 of the text."""
    return bpe.digests(docs)


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return (docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs).select(*columns)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs


#: The components of near duplicates and the merges of a tokenizer have no practical SQL; tests hold both against brute force.
ORACLE_SQL = None
