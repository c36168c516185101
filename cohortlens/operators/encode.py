"""One-hot encoding of categorical feature columns.

Per column, the ``top_n`` most frequent non-null values (ties: smaller value
first) get a boolean column ``<col> = <value>``; one more boolean column
``<col> is unknown`` is true for every other value, null included.  The
original column is replaced.  The frequency table is a distributed
``groupBy``; only ``top_n`` values per column reach the driver.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, functions as F

from .grouping import safe_token

DEFAULT_TOP_N = 10


def top_values(df: DataFrame, column: str, top_n: int = DEFAULT_TOP_N) -> list:
    rows = (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("__n"))
            .orderBy(F.col("__n").desc(), F.col(column).asc())
            .limit(top_n).collect())
    return [r[0] for r in rows]


def encoded_name(column: str, value) -> str:
    return f"{column}__is_{safe_token(value)}"


def unknown_name(column: str) -> str:
    return f"{column}__is_unknown"


def one_hot(df: DataFrame, columns: list[str], top_n: int = DEFAULT_TOP_N,
            include_unknown: bool = True, values: dict[str, list] | None = None
            ) -> tuple[DataFrame, dict[str, list]]:
    """Return the encoded frame and the kept values per column.

    ``values`` (e.g. saved from a training run) skips the frequency jobs so a
    scoring set is encoded with the training categories.
    """
    kept = dict(values or {})
    todo = [c for c in columns if c not in kept]
    if todo:
        # independent small jobs: submitted together, not one after another
        with ThreadPoolExecutor(max_workers=min(4, len(todo))) as pool:
            for c, top in zip(todo, pool.map(lambda c: top_values(df, c, top_n), todo)):
                kept[c] = top
    out_cols = []
    for name in df.columns:
        if name not in columns:
            out_cols.append(F.col(name))
            continue
        col = F.col(name)
        for v in kept[name]:
            out_cols.append(col.eqNullSafe(F.lit(v)).alias(encoded_name(name, v)))
        if include_unknown:
            known = col.isin(kept[name]) if kept[name] else F.lit(False)
            out_cols.append((~F.coalesce(known, F.lit(False))).alias(unknown_name(name)))
    return df.select(*out_cols), kept
