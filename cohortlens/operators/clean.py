"""Column-level cleaning: drop all-null columns, fill nulls, union by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def non_null_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """Non-null count per column in one pass (one row reaches the driver)."""
    columns = columns or df.columns
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first()
    return {c: int(row[c]) for c in columns}


def drop_all_null_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop every column that holds no value (eager: the schema depends on data).

    Columns in ``keep`` (keys, time columns) always stay.
    """
    counts = non_null_counts(df, [c for c in df.columns if c not in keep])
    return df.select(*[c for c in df.columns if c in keep or counts.get(c, 1) > 0])


def fill_missing(df: DataFrame, column: str, value="NA") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Stack frames; columns are merged by name, missing ones read null, rows kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
