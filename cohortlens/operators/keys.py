"""Row keys, links and buckets.

* duplicate keys  — ``groupBy(key).count() > 1`` (partial aggregation);
* orphan links    — child key counts anti-joined to the parent keys; the child
  side is pre-aggregated so a hot person is one row before the shuffle;
* generated keys  — dense ``0..n-1`` ids in a total content order, assigned
  distributedly (range-partitioned sort, per-partition offsets) — never a
  global ``row_number()`` window, which runs in a single task;
* buckets         — ``pmod(xxhash64(person), n)``: deterministic, so every
  table gets the same bucket for a person without a join.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written


def duplicate_keys(df: DataFrame, key_cols: list[str], out: str = "n_rows") -> DataFrame:
    """Key values that occur more than once, with their row counts."""
    return (df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias(out))
            .where(F.col(out) > 1))


def split_duplicates(df: DataFrame, key_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key occurs once, rows whose key is repeated or null)."""
    whole = reduce(and_, [F.col(c).isNotNull() for c in key_cols])
    repeated = duplicate_keys(df.where(whole), key_cols).select(*key_cols)
    once = df.where(whole).join(repeated, key_cols, "left_anti").select(*df.columns)
    return once, df.where(whole).join(repeated, key_cols, "left_semi").select(*df.columns).unionByName(df.where(~whole))


def orphan_links(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str,
                 out: str = "n_rows") -> DataFrame:
    """Child link values without a parent row (null links included)."""
    per_key = child.groupBy(child_key).agg(F.count(F.lit(1)).alias(out))
    parents = parent.select(F.col(parent_key).alias("__pk"))
    return per_key.join(parents, F.col(child_key) == F.col("__pk"), "left_anti")


def bucket_of(col: str | Column, n_buckets: int) -> Column:
    """Deterministic bucket in ``[0, n_buckets)`` for a person key."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.xxhash64(c), F.lit(n_buckets)).cast("int")


def with_bucket(df: DataFrame, person_key: str, n_buckets: int,
                out: str = "partition") -> DataFrame:
    return df.withColumn(out, bucket_of(person_key, n_buckets))


def generate_key(df: DataFrame, key: str, order_cols: list[str] | None = None,
                 dense: bool = True, n_partitions: int | None = None) -> DataFrame:
    """Add a row key column ``key``.

    ``dense=False``: ``monotonically_increasing_id()`` — unique, no shuffle, but
    depends on the input file split.

    ``dense=True``: ids ``0..n-1`` in the total order ``order_cols`` (default:
    all columns), stable across runs and file layouts:

    1. range-partition and sort by the full order (range bounds are sampled
       over the whole key, so one person's rows can span partitions);
    2. each row gets (partition id, position in partition);
    3. the positioned rows are written as Parquet to the shared checkpoint folder —
       a lost executor then re-reads them instead of re-sorting, and both
       uses below see the same positions;
    4. per-partition counts (one row per partition) → running offsets,
       broadcast back (size bounded by the partition count).
    """
    if not dense:
        return df.withColumn(key, F.monotonically_increasing_id())
    order_cols = order_cols or list(df.columns)
    # no explicit count by default: AQE sizes the range exchange (initial
    # partition number, then coalescing of adjacent ranges — order is kept)
    by_range = (df.repartitionByRange(n_partitions, *order_cols) if n_partitions
                else df.repartitionByRange(*order_cols))
    ordered = by_range.sortWithinPartitions(*order_cols)
    pid = F.spark_partition_id()
    positioned = ordered.select(
        "*", pid.alias("__pid"),
        (F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)).alias("__pos"))
    positioned = written(positioned, "positioned-rows")
    sizes = positioned.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: a single-task window over a few thousand rows
    offsets = sizes.select(
        "__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__off"))
    return (positioned.join(F.broadcast(offsets), "__pid")
            .select(*df.columns, (F.col("__off") + F.col("__pos")).alias(key)))
