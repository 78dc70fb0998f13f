"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, langid, lattice, mixing, quality, secrets, simhash, toxicity, warc
from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of op1's method: classes of equal texts, and components of those of Jaccard 0.8 or more."""
    return fingerprints.near_duplicates(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archive(*warc.write_archive(table(spark, sf_dir, "pages", ["page_id", "url", "html"])))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", ["doc_id", "text", "source"]))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    model = toxicity.learn(docs, table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    return toxicity.score(docs, model)


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return quality.resample(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"]))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    return langid.identify(docs, langid.learn(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_warc": op2_warc,
    "op3_bpe": op3_bpe,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_lattice": op8_lattice,
    "op9_quality": op9_quality,
    "op10_langid": op10_langid,
    "minhash_near_duplicates": minhash_near_duplicates,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages""",
}
