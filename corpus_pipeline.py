"""Corpus preparation: language, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; all but the last return the columns of ``documents``.  ``run`` writes each
stage's result as Parquet into the cluster's shared folder and reads it again.
Null ids, null texts and repeated rows are treated as the operators' modules say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import bpe_codec, dart_minhash, decontaminate, language_cnn, pii_semicrf
from panelloom.llm.shared_store import Scratch, step


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go."""
    return language_cnn.in_known_language(docs, language_cnn.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id."""
    return dart_minhash.one_of_each(spark, docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; n_chars follows the new text."""
    return pii_semicrf.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, and whether decoding gives the text back."""
    coded = bpe_codec.encode_columns(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"))
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Trained models and exact similarity classes have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way goes with it, and its result when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        table = Scratch(spark)
        with step(spark):
            docs = table.keep(stage(spark, docs, sf_dir), name)
        if before:
            before[0].drop(before[1])
        before = table, name
    return STAGES[-1][1](spark, docs, sf_dir)
