"""Conditional features of any number of codes as sparse vectors.

A column per code ends where a plan gets too wide.  Here each person has one vector: sorted
``indices`` and their ``values``; a dictionary table says which code and statistic an index is.  The
dictionary is numbered in Spark by a range sort of the distinct codes, so neither it nor the codes
pass through the driver.  A vector holds the codes that its person has, not the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .keys import generate_key


def feature_dictionary(long: DataFrame, concept: str, stats: list[str]) -> DataFrame:
    """``index, code, statistic``: codes in order, the statistics of a code next to each other."""
    codes = generate_key(long.select(F.col(concept).alias("code")).where("code IS NOT NULL").distinct(), "number", dense=True)
    return codes.select(F.posexplode(F.array(*[F.lit(s) for s in stats])).alias("at", "statistic"), "code", "number").select(
        (F.col("number") * len(stats) + F.col("at")).alias("index"), "code", "statistic")


def to_sparse(long: DataFrame, keys: list[str], concept: str, stats: list[str], dictionary: DataFrame, out: str) -> DataFrame:
    """One row per ``keys``: struct ``out`` of ``indices`` (ascending) and ``values`` of the statistics that aren't null."""
    cells = F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value")) for s in stats])
    cells = long.select(*keys, F.col(concept).alias("code"), F.explode(cells).alias("c")).select(*keys, "code", "c.statistic", "c.value")
    placed = cells.where("value IS NOT NULL").join(dictionary, ["code", "statistic"]).select(*keys, F.struct("index", "value").alias("cell"))
    listed = placed.groupBy(*keys).agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return listed.select(*keys, F.struct(F.col("cells.index").alias("indices"), F.col("cells.value").alias("values")).alias(out))


def from_sparse(vectors: DataFrame, keys: list[str], column: str, dictionary: DataFrame) -> DataFrame:
    """``keys, code, statistic, value``: the vectors as rows."""
    cells = vectors.where(F.col(column).isNotNull()).select(*keys, F.explode(F.arrays_zip(f"{column}.indices", f"{column}.values")).alias("c"))
    return cells.select(*keys, F.col("c.indices").alias("index"), F.col("c.values").alias("value")).join(dictionary, "index").select(*keys, "code", "statistic", "value")
