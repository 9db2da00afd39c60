"""A training-corpus pipeline: each stage is one operator over all that its predecessor kept."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skarn.llm import bpe, decontam, langid, pii, simhash
from skarn.llm.common import written


def keep_identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or whose language stays unsure, go; the model learns from the rows with a ``lang``."""
    model = langid.fit(docs.select("doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return simhash.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind in brackets; every document stays."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_sha256): token ids of each text, and a digest of what they decode to."""

    def take(ids: bytes, decoded: str) -> tuple[bytes, int, str]:
        return ids, len(ids) // 4, hashlib.sha256(decoded.encode()).hexdigest()

    columns = [("ids", pa.binary(), "binary"), ("n_tokens", pa.int64(), "long"), ("decoded_sha256", pa.string(), "string")]
    return bpe.coded(docs, public_tokenizers.path("word_bpe_49k.json"), take, columns)


STAGES = [
    ("language", keep_identified_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("encoding", encode),
]

#: Models, fingerprints and tokenisers have no SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
