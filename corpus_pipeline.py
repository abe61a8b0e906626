"""Corpus pipeline: quality, near duplicates, secrets, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; ``run`` writes
each stage's rows as Parquet in the shared folder and reads them back for the
next.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, mixing, quality, secrets, simhash
from gleaner.llm.common import materialise, table
from gleaner.session import ship_package

# Share of all tokens wanted of good, low and toxic text, and all tokens wanted
# relative to those there are.  No document's rate falls below one: the stage
# repeats documents and drops none.
MIX_WEIGHTS, MIX_GROWTH, MIX_LEAST = [0.90, 0.01, 0.09], 1.25, 1.0

# Smaller than the codec's own: here executors have served other stages, and their heaps have grown.
TOKEN_CACHES = (15_000, 60_000, 120_000)

# SQL can state neither a trained model nor a tokenizer; tests hold the stages
# against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores 0.3 or more; it learns from the labels outside the held-out fold."""
    ship_package(spark)
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the one of smallest doc_id (then hash, then arrival)."""
    ship_package(spark)
    return simhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced by ``[REDACTED:kind]``."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, some repeated, so that expected token totals come near the shares wanted."""
    ship_package(spark)
    model = mixing.fit_domains(docs, mixing.labelled_domains(table(spark, sf_dir, "labels")), mixing.DOMAINS)
    members = materialise(mixing.memberships(docs, model), "mix-members")
    mix = mixing.fit_rates(members, model, MIX_WEIGHTS, MIX_GROWTH, MIX_LEAST)
    return mixing.apply_mix(docs, mix)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's tokens: ``doc_id, n_tokens, ids, ids_sha256, decoded_sha256``."""
    ship_package(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, caches=TOKEN_CACHES)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level BPE", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
