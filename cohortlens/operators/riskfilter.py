"""Hashed at-risk filter: a Bloom filter as rows, and its probe by join.

Reported keys are stored as set bits only: each key's salted SHA-256 gives ``hashes`` positions, and
the positions of one bucket of 32,768 bits are one bitmap (``bitmap_construct_agg``).  The table
``(bucket, bits)`` names no key and no reporter; its size follows from the bits, not the rows.
Building is one partial aggregate on the bucket.  A probe turns each candidate key into its positions and
joins them to their buckets; a key is flagged when all its positions are set.  No reported key is ever missed;
others are flagged at about ``(1 - exp(-hashes / bits_per_key)) ** hashes``.

Null keys are neither stored nor flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKET_BITS = 32_768  # fixed: of Spark's bitmap functions
DIGITS = 12           # hexadecimal digits of one position
BITS_PER_KEY = 10
HASHES = 4            # at most 5: one SHA-256 holds 64 digits


def filter_bits(n_keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    """Size of a filter for ``n_keys`` keys: whole buckets."""
    return max(1, -(-n_keys * bits_per_key // BUCKET_BITS)) * BUCKET_BITS


def positions(key: Column, n_bits: int, salt: str, hashes: int = HASHES) -> Column:
    """Array of the key's positions in ``0 .. n_bits - 1``."""
    if not 1 <= hashes <= 64 // DIGITS:
        raise ValueError(f"hashes is 1 to {64 // DIGITS}")
    digest = F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)
    return F.array(*[F.pmod(F.conv(F.substring(digest, 1 + i * DIGITS, DIGITS), 16, 10).cast("long"), F.lit(n_bits)) for i in range(hashes)])


def build_filter(reports: DataFrame, key: str, n_bits: int, salt: str, hashes: int = HASHES) -> DataFrame:
    """``bucket, bits``: the buckets with a set bit."""
    at = reports.where(F.col(key).isNotNull()).select(F.explode(positions(F.col(key), n_bits, salt, hashes)).alias("p"))
    # bitmap_bucket_number counts from 1 at position 1
    return (at.select((F.col("p") + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")))


def merge_filters(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two filters of one size, salt and number of hashes."""
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def probe_filter(candidates: DataFrame, key: str, filter_rows: DataFrame, n_bits: int, salt: str, hashes: int = HASHES) -> DataFrame:
    """``key, flagged`` of each distinct candidate key.

    Positions are uniform, so no bucket is hot; a repeated candidate is probed once."""
    keys = candidates.where(F.col(key).isNotNull()).select(key).distinct()
    at = keys.select(key, F.explode(positions(F.col(key), n_bits, salt, hashes)).alias("p")).select(key, (F.col("p") + 1).alias("p"))
    at = at.select(key, F.bitmap_bucket_number("p").alias("bucket"), F.bitmap_bit_position("p").alias("bit"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, F.pmod(F.col("bit"), F.lit(8)).cast("int")) == 1, F.lit(False))
    return at.join(filter_rows, "bucket", "left").select(key, is_set.alias("set")).groupBy(key).agg(F.bool_and("set").alias("flagged"))
