"""Sharding and rollups on tables where many rows repeat one id and text, or have no id."""

import collections
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from cohortlens.llm import byte_bpe, sharding, token_rollup

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


def shards_of(df, shards=16):
    rows = sharding.digest(df, shards).collect()
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows, size


@pytest.mark.parametrize("key", [7, None])
def test_repeated_rows_are_spread_over_all_shards(spark, key):
    rows = [(key, "copy text ten")] * 4000 + [(100 + i, f"other text of row {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, size = shards_of(df)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((k, len(t) + 1, zlib.crc32(t.encode())) for k, t in rows)
    mean = sum(size.values()) / 16
    assert len(size) == 16 and max(size.values()) <= 1.05 * mean and min(size.values()) >= 0.95 * mean


def test_one_row_repeated_alone(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    _, size = shards_of(df, 8)
    assert len(size) == 8 and max(size.values()) <= 1.05 * 750


def test_rows_without_an_id_count_each(spark, tmp_path):
    enc = tiktoken.Encoding("r", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.encoder(MULTI, P.PATTERN).ranks, special_tokens={})
    rows = [(None, "same text", "s", "en")] * 2500 + [(None, "un texte", "s", "fr")] * 500 + [(i, f"text {i % 5}", "s", "en") for i in range(20)] + [(50, "ein text", "s", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {(r.lang, r.version): (r.n_docs, r.n_tokens, r.n_chars) for r in token_rollup.maintained(df, ("a", MULTI), ("b", MULTI), P.PATTERN, str(tmp_path / "r")).collect()}

    def sums(texts):
        return len(texts), sum(len(enc.encode_ordinary(t)) for t in texts), sum(map(len, texts))

    assert got == {("en", "a"): sums(["same text"] * 2500 + [f"text {i}" for i in range(5)]), ("fr", "a"): sums(["un texte"] * 500), ("de", "b"): sums(["ein text"])}
