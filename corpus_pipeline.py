"""A corpus pipeline of the operators in almanack.llm: each stage takes what the one before it kept.

The rows of ``run`` come from models and tokenizers, which SQL can't express, so
``ORACLE_SQL`` is None; tests/llm/test_pipeline.py holds them against the stages
by brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from almanack.llm import decontam, exactdedup, langid, neardup, packing, shared
from almanack.llm.queries import load, tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; it learns from those whose crc32 isn't 2 modulo 4."""
    shared.ship(spark)
    names, model = langid.train(docs, langid.bucket() % 4 != 2)
    return langid.keep(docs, names, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    shared.ship(spark)
    return exactdedup.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, the row with the least doc_id."""
    shared.ship(spark)
    return neardup.keep(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth is benchmark text."""
    return decontam.keep(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    shared.ship(spark)
    return packing.digests(packing.pack(docs, tokenizer("byte_bpe_50k.json"), window=1024, end_id=0))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is a table in the shared folder before the next reads it, and what it needed on the way is dropped."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with shared.scratch(spark) as keep:
            docs = shared.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(docs)
    return docs
