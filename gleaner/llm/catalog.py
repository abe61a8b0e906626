"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import ann, bpe, chat, media, mixing, quality, secrets, shards, simhash, urls
from gleaner.llm.common import scratch_path, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


ARRIVALS = 4


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four lots, are compacted, and are read back by the last manifest."""
    store = shards.ShardStore(spark, scratch_path(spark, "store"))
    docs = table(spark, sf_dir, "documents")
    store.append_lots(docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS)))
    store.compact()
    store.vacuum(grace_seconds=0)  # nothing else writes here
    found = store.read()
    return (docs.limit(0) if found is None else found).select(
        "doc_id", "lang", "source", "n_chars", F.sha2(F.col("text"), 256).alias("text_sha256")
    )


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        keep_ids=False,
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(table(spark, sf_dir, "conversations"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"), keep_media=False)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_shards": op2_shards,
        "op3_urls": op3_urls,
        "op4_mixing": op4_mixing,
        "op5_bpe": op5_bpe,
        "op6_chat": op6_chat,
        "op7_ann": op7_ann,
        "op8_media": op8_media,
        "op9_quality": op9_quality,
        "op10_simhash": op10_simhash,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """SQL twins; trained models, tokenizers, media and fingerprints are tested by brute force instead."""
    return {
        "op2_shards": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
        "op6_chat": """
WITH added AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) + 24 AS written FROM added
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(written) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    }
