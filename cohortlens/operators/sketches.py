"""Approximate distinct counts from sketches that can be kept and merged.

A HyperLogLog sketch per person and day is a few bytes for few values and never more than about
``2 ** lg_k`` bytes; any span of days, or of persons, is the union of its sketches, so a new day is added without
reading the old rows.  The relative standard error is ``1.04 / sqrt(2 ** lg_k)``; ``error_bound`` gives
three of them, at least one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LG_K = 12


def error_bound(exact: Column, lg_k: int = LG_K) -> Column:
    """How far an estimate may lie from an exact count."""
    return F.greatest(F.lit(1.0), exact * F.lit(3 * 1.04 / 2 ** (lg_k / 2)))


def sketch_of(column: str, lg_k: int = LG_K) -> Column:
    """Aggregate: the sketch of a column's non-null values (of any type, compared as text)."""
    return F.hll_sketch_agg(F.col(column).cast("string"), F.lit(lg_k))


def daily_sketches(rows: DataFrame, person_key: str, time: str, column: str, lg_k: int = LG_K) -> DataFrame:
    """``person_key, day, sketch``; days without a value have no row."""
    seen = rows.where(F.col(column).isNotNull() & F.col(time).isNotNull())
    return seen.groupBy(person_key, F.to_date(time).alias("day")).agg(sketch_of(column, lg_k).alias("sketch"))


def merge_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """The union of the sketches of each group."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame, out: str = "num_unique") -> DataFrame:
    """The sketch column replaced by its estimated distinct count."""
    return sketches.withColumn(out, F.hll_sketch_estimate("sketch")).drop("sketch")
