"""Per-person and per-(person, concept) aggregation.

Shapes, from cheapest to most expensive at wide concept sets:

* long  — ``groupBy(person, concept)``: one row per pair; map-side partial
  aggregation keeps a hot person down to one buffer per task and concept.
* map   — long, then one ``map<concept, struct<stats>>`` per person; the map
  is bounded by the concept vocabulary, never by the person's row count.
* wide  — long, then a pivot on an explicit, sorted value list (conditional
  aggregates over the grouped rows for small cell counts, Spark's ``pivot``
  beyond).  Never one conditional aggregate per concept on the raw rows (5x
  slower at 1,000 columns and a plan that grows with the vocabulary).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .joins import fits_broadcast

# A wide layout beyond this many pivot values is refused: use long or map.
MAX_WIDE_VALUES = 10_000


def distinct_values(df: DataFrame, column: str, max_values: int = MAX_WIDE_VALUES) -> list:
    """Sorted distinct non-null values of a column (the concept vocabulary).

    The aggregate runs distributed; only the vocabulary reaches the driver,
    and only up to ``max_values`` (checked with a bounded ``limit``, then
    refused rather than cut).
    """
    vals = (df.where(F.col(column).isNotNull()).select(column).distinct()
            .orderBy(column).limit(max_values + 1).collect())
    if len(vals) > max_values:
        raise ValueError(f"{column} has more than {max_values} distinct values; "
                         "use the long or map layout")
    return [r[0] for r in vals]


def by_person(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)


def conditional_long(df: DataFrame, keys: list[str], concept: str,
                     aggs: list[Column]) -> DataFrame:
    """One row per (person, concept value); null concepts select no rows."""
    return df.where(F.col(concept).isNotNull()).groupBy(*keys, concept).agg(*aggs)


def long_to_map(long: DataFrame, keys: list[str], concept: str, stats: list[str],
                map_col: str = "features") -> DataFrame:
    """Per person: ``map<concept, struct<stats>>``."""
    entry = F.struct(F.col(concept).alias("key"),
                     F.struct(*[F.col(s) for s in stats]).alias("value"))
    return long.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias(map_col))


def safe_token(value) -> str:
    """SQL-safe token for a concept value in a column name; different texts give different tokens.

    Letters, digits and underscores stay; any other character becomes its code point, ``_x2D_``
    for a minus sign.  What looks like such a code already has its first underscore written so."""
    text = re.sub(r"_(?=x[0-9A-F]+_)", "_x5F_", str(value))
    return re.sub(r"[^0-9A-Za-z_]", lambda m: f"_x{ord(m[0]):X}_", text) or "_x_"


# Up to this many output cells per person a pivot is written as conditional
# aggregates in one groupBy (one shuffle of the grouped rows).  Beyond it
# Spark's pivot is used: constant work per row (PivotFirst), but one more
# shuffle, because its first phase regroups by (person, value).
MANUAL_PIVOT_CELLS = 256


def value_place(df: DataFrame, column: str, values: list) -> Column:
    """Place of a column's value in a list, from 1; null where it is not there.  Compared as the column's type, so
    no value depends on how it is written."""
    kind = df.schema[column].dataType.simpleString()
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col(column)), F.lit(0).cast("long"))


def pivot_rows(df: DataFrame, keys: list[str], pivot_col: str,
               cells: list[tuple[object, str, str]]) -> DataFrame:
    """Spread rows with one row per (keys, pivot value) into columns.

    ``cells`` lists ``(pivot value, source column, output name)``.
    """
    if not cells:
        return df.select(*keys).distinct()
    if len(cells) <= MANUAL_PIVOT_CELLS:
        return df.groupBy(*keys).agg(*[
            F.max(F.when(F.col(pivot_col) == F.lit(v), F.col(src))).alias(out)
            for v, src, out in cells])
    values = list(dict.fromkeys(v for v, _, _ in cells))
    stats = list(dict.fromkeys(src for _, src, _ in cells))
    placed = df.withColumn("__place", value_place(df, pivot_col, values))
    pivoted = (placed.groupBy(*keys).pivot("__place", list(range(1, len(values) + 1)))
               .agg(*[F.first(F.col(st)).alias(st) for st in stats]))
    place = {v: i for i, v in enumerate(values, 1)}
    names = [f"{place[v]}_{src}" if len(stats) > 1 else f"{place[v]}" for v, src, _ in cells]
    if pivoted.columns == list(keys) + names:
        # the cells are the full value-major grid, in Spark's output order:
        # rename in one step (one driver call per column less than a select)
        return pivoted.toDF(*keys, *[out for _, _, out in cells])
    return pivoted.select(*keys, *[F.col(f"`{n}`").alias(out) for n, (_, _, out) in zip(names, cells)])


def long_to_wide(long: DataFrame, keys: list[str], concept: str, values: list,
                 stats: dict[str, str]) -> DataFrame:
    """Pivot the long form on an explicit value list.

    ``stats`` maps a long-form column to a name template containing
    ``{value}``; the output has one column per (value, stat).
    """
    if len(values) > MAX_WIDE_VALUES:
        raise ValueError("too many pivot values; use the long or map layout")
    cells = [(v, st, tpl.format(value=safe_token(v))) for v in values for st, tpl in stats.items()]
    return pivot_rows(long, keys, concept, cells)


def n_most_common(df: DataFrame, keys: list[str], column: str, n: int = 3,
                  out: str = "n_most_common") -> DataFrame:
    """Per person: the ``n`` most frequent values, most frequent first, ties by value.

    Counted as ``groupBy(person, value)`` (partial aggregation), then ranked
    inside each person's small (person, value) set.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(F.col("__n").desc(), F.col(column).asc())
    top = counts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return top.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__r", column))),
                    lambda s: s[column]).alias(out))


def entropy(df: DataFrame, keys: list[str], column: str, out: str = "entropy") -> DataFrame:
    """Per person: Shannon entropy (natural log) of the value distribution.

    Nulls count as a value, as in the pandas ``value_counts(dropna=False)``
    definition.
    """
    # H = ln N - (1/N) * sum(n_i ln n_i): two sums per person, no window.
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    agg = counts.groupBy(*keys).agg(F.sum("__n").alias("__N"),
                                    F.sum(F.col("__n") * F.log(F.col("__n"))).alias("__S"))
    return agg.select(*keys, (F.log(F.col("__N")) - F.col("__S") / F.col("__N")).alias(out))


def grouped_mode(df: DataFrame, keys: list[str], column: str, out: str = "mode") -> DataFrame:
    """Per group: the most frequent non-null value, smallest value on ties.

    Two aggregations with partial phases — counts per (group, value), then
    ``min_by(value, (-count, value))`` — so no group's values are ever held
    together (Spark's ``mode`` keeps a per-group hash map of all values).
    """
    counts = (df.where(F.col(column).isNotNull()).groupBy(*keys, column)
              .agg(F.count(F.lit(1)).alias("__c")))
    return counts.groupBy(*keys).agg(
        F.min_by(F.col(column), F.struct((-F.col("__c")).alias("c"), F.col(column).alias("v"))).alias(out))


def grouped_median(df: DataFrame, keys: list[str], column: str, out: str = "median",
                   n_partitions: int | None = None) -> DataFrame:
    """Per group: exact median of the non-null values (mean of the two middle
    values for an even count), without collecting any group.

    1. range-partition and sort all (group, value) rows: a hot group spans
       several partitions;
    2. number rows inside each partition and write them as Parquet (both uses below see the
       same positions, and a lost executor re-reads instead of re-sorting);
    3. per (partition, group) segment: first position and row count; a window
       over each group's segments (at most one per partition) gives running
       offsets and the group size;
    4. the segment holding rank (n-1)//2 and n//2 names the two rows to pick;
       an equi-join on (partition, position) fetches them (the picks are
       broadcast when a bounded count allows, else both sides are shuffled).
    """
    vals = df.where(F.col(column).isNotNull()).select(*keys, column)
    by_range = (vals.repartitionByRange(n_partitions, *keys, column) if n_partitions
                else vals.repartitionByRange(*keys, column))   # AQE sizes it
    ordered = by_range.sortWithinPartitions(*keys, column)
    pid = F.spark_partition_id()
    pos = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    rows = written(ordered.select(*keys, column, pid.alias("__pid"), pos.alias("__pos")), "median-rows")
    seg = rows.groupBy("__pid", *keys).agg(F.min("__pos").alias("__start"),
                                          F.count(F.lit(1)).alias("__cnt"))
    by_group = Window.partitionBy(*keys)
    seg = (seg.withColumn("__off", F.sum("__cnt").over(by_group.orderBy("__pid")) - F.col("__cnt"))
           .withColumn("__n", F.sum("__cnt").over(by_group)))
    ranks = F.array_distinct(F.array(F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)))
    targets = (seg.select("__pid", "__start", "__off", "__cnt", F.explode(ranks).alias("__m"))
               .where((F.col("__m") >= F.col("__off")) & (F.col("__m") < F.col("__off") + F.col("__cnt")))
               .select("__pid", (F.col("__start") + F.col("__m") - F.col("__off")).alias("__pos")))
    # at most two picks per group: written once, counted with a bound, and
    # broadcast when small, so the positioned rows are scanned, not shuffled
    targets = written(targets, "median-picks")
    if fits_broadcast(targets):
        targets = F.broadcast(targets)
    picked = rows.join(targets, ["__pid", "__pos"], "inner")
    return picked.groupBy(*keys).agg(F.avg(F.col(column)).alias(out))
