"""A training corpus from ``documents``: language, near duplicates, benchmark, mix, token records.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and its result is written as
Parquet and read again as the next one's ``docs``. All but the last keep the columns of ``documents``, whatever they
are. Null ids are kept apart by text; null or letterless texts end at the first stage; an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postsieve.llm import decontam, language, mixing, simhash, tokens
from postsieve.llm.common import importable, table
from postsieve.plans.durable import written

TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language."""
    importable(spark)
    return language.accept(docs, language.train(docs.where(~language.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component of near duplicates; of rows that repeat its id and
    fingerprint, one."""
    importable(spark)
    return simhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a part of a benchmark item."""
    importable(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents until each source has its share; at most one document of a source is cut."""
    importable(spark)
    return mixing.apply(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token records and list them: doc_id, start, n_tokens, ids_crc32."""
    importable(spark)
    return tokens.token_records(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


#: Fingerprints, mixtures and tokenizers are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None
