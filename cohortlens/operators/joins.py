"""Joins of the table set: code lookup, label attach, feature assembly.

Broadcasts happen only behind a size check: the dictionary is counted with a
bounded ``limit`` first, and above the bound the join is left to the planner
(sort-merge, or AQE's run-time broadcast when the measured side is small).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Rows of a (code, name) lookup table that may be broadcast: at ~70 bytes a
# row this stays under ~100 MB per executor.
MAX_BROADCAST_ROWS = 1_500_000


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows: a distributed count, one number per task."""
    return df.count() <= max_rows


def has_known_size(df: DataFrame) -> bool:
    """Whether the planner knows a size of ``df`` (files do say theirs, rows in memory don't)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 60


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def lookup_join(df: DataFrame, dictionary: DataFrame, code_col: str,
                dict_key: str = "concept_id", name_col: str = "concept_name",
                out_col: str | None = None, small: bool | None = None) -> DataFrame:
    """Left join ``dictionary[name_col]`` onto ``df`` where ``code = dict_key``.

    Codes repeated in the dictionary multiply rows; a missing or null code
    gives a null name.  The planner broadcasts a dictionary whose files are under
    ``spark.sql.autoBroadcastJoinThreshold``; only one without files is counted first.  ``small`` is for
    callers that know more.
    """
    out_col = out_col or name_col
    d = dictionary.select(F.col(dict_key).alias("__code"), F.col(name_col).alias(out_col))
    if small is None:
        small = not has_known_size(d) and fits_broadcast(d)
    if small:
        d = F.broadcast(d)
    return df.join(d, F.col(code_col) == F.col("__code"), "left").drop("__code")


def attach_label(features: DataFrame, label: DataFrame, key: str) -> DataFrame:
    """Right join: exactly the labelled persons; a label without features keeps
    null features."""
    return features.join(label, key, "right")


def attach_status(person: DataFrame, label: DataFrame, key: str) -> DataFrame:
    """Left join of the label onto persons (by key, not by row position)."""
    return person.join(label, key, "left")


def assemble(target: DataFrame, key: str | list[str], parts: list[DataFrame],
             defaults: dict[str, object] | None = None) -> DataFrame:
    """Left-join per-child aggregates (one row per person each) onto the target.

    Every part comes out of a ``groupBy(key)`` and is already hash-partitioned
    on the key, so the chain of joins shuffles only the target once.
    """
    out = reduce(lambda acc, p: acc.join(p, key, "left"), parts, target)
    if defaults:
        out = out.fillna({c: v for c, v in defaults.items() if c in out.columns})
    return out
