"""From raw documents to mixed token files in five stages.

Each stage takes all that its predecessor kept, written as Parquet and read
again; all but the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calibra.llm.common import cut, table
from calibra.llm.decontaminate import decontaminate
from calibra.llm.language_id import keep_identified
from calibra.llm.mixing import mix
from calibra.llm.near_dedup import keep_one
from calibra.llm.token_store import default_tokenizer, token_digest, write_tokens
from calibra.session import fresh_path

MIX_REPETITION = 2.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language, ``lang`` set to it."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return keep_one(docs, shingle_words=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice."""
    return mix(docs, target="repetition", value=MIX_REPETITION)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ORC; returns doc_id, start, n_tokens and checksum read from them."""
    path = fresh_path(spark, "llm-tokens")
    write_tokens(docs, path, default_tokenizer())
    return token_digest(spark, path)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]

ORACLE_SQL = None       # language model, edit distances and a tokenizer: checked against brute force in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage{i + 1}")
    return docs
