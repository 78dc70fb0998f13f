"""Corpus pipeline: quality, near-duplicates, secrets, mixing and token ids, each stage over all the last one kept.

A stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.  Nulls, empty texts, repeated rows, empty tables
and further columns pass as the operators define it; columns other than doc_id, text, source and n_chars are carried.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagequarry.llm import bpe, mixing, quality, secrets, simhash
from pagequarry.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws; those it rejects go."""
    return quality.selected(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"]))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id."""
    return simhash.deduplicated(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets."""
    return secrets.redacted(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each time a document is taken, the one at a source's cut with its first words only."""
    return mixing.mixture(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit) and the SHA-256 of the ids decoded."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return ids.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]
#: Hashes, trained ratios and token ids are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
