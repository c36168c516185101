"""Registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (byte_bpe, fingerprints, jaccard_join, langid, packing, periodic_runs, quality, sharding, spelling, suffix_lm, token_rollup, url_cascade,
               warc)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash of every text and of its edited text."""
    return fingerprints.against_neighbour(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger and its verdict on every document."""
    return quality.judged(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version after loading, revising and deleting."""
    return token_rollup.maintained(
        _table(spark, sf_dir, "documents"), ("byte_bpe_50k", public_tokenizers.path("byte_bpe_50k.tiktoken")),
        ("byte_bpe_multi_50k", public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return url_cascade.judged(_table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-model and suffix-tree score of every document."""
    return suffix_lm.scored(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return jaccard_join.linked(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes decoded from them, as digests."""
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, 16 shards of near equal bytes."""
    return sharding.digest(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identified(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, and what is left when they are collapsed."""
    return periodic_runs.digest(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return spelling.grouped(_table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("fault")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fingerprints, op2_quality_rules, op3_token_counts, op4_packing, op5_url_filter, op6_lm_scoring,
                            op7_ngram_jaccard, op8_byte_bpe, op9_sharding, op10_language_id, op11_periodic_runs, op12_spelling_variants, op13_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.judged_sql(), "op5_url_filter": url_cascade.judged_sql(), "op13_warc": warc.round_trip_sql()}
