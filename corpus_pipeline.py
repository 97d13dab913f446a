"""A training corpus from documents: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from symreach.llm.common import cut, table
from symreach.llm.langid import keep_identified
from symreach.llm.linededup import dedup_lines
from symreach.llm.minhash import keep_one
from symreach.llm.mixing import mixed_documents
from symreach.llm.packing import digest, pack

TOKENIZER = "byte_bpe_50k.json"
#: The least similarity, in per cent, at which the stage takes two documents for copies.
NEAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay."""
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go from all but one."""
    return dedup_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one(docs, NEAR)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights take it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of power-of-two length, with the ids' CRC-32."""
    return digest(pack(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [("language ID", language), ("line dedup", lines), ("near-dedup", near), ("mixing", mixture), ("packing", packing)]

#: SQL cannot express the trained, hashed and tokenised stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut(docs), sf_dir)
    return docs
