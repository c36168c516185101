"""Aggregates as of several cutoffs a person, in one pass over the child rows.

Each row goes to the first of its person's cutoffs that sees it.  Rows are aggregated by (person, that
cutoff) into partial states that can be merged, and a window over the person's cutoffs merges each
state with all before it.  So a row is read, shuffled and aggregated once however many cutoffs
there are, where repeating the rows for each cutoff would multiply them.

The states of a mean, a standard deviation and so on are sums: ``std`` merges counts, means and squared
deviations.  Primitives without such a state (skew, median, ...) are not offered here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import seconds_between
from .visibility import CUTOFF_COL, attach_cutoff

MERGEABLE = {"count", "mean", "sum", "max", "min", "std", "last", "first", "time_since_last", "time_since_first",
             "avg_time_between", "num_true", "percent_true", "any", "all"}

_State = list[tuple[str, Column, str]]  # (name, partial aggregate, how it merges)


def _state(prim: str, value: str | None, time: str, key: str | None, out: str) -> tuple[_State, Callable[[Column], Column]]:
    """Partial states of one primitive, and its result from the merged states at a cutoff."""
    def named(*parts: tuple[str, Column, str]) -> _State:
        return [(f"__{out}__{n}", c, how) for n, c, how in parts]

    def got(n: str) -> Column:
        return F.col(f"`__{out}__{n}`")

    v = F.col(f"`{value}`") if value else None
    t = F.col(f"`{time}`")
    if prim == "count":
        return named(("n", F.count(F.lit(1)), "sum")), lambda cut: F.coalesce(got("n"), F.lit(0)).cast("long")
    if prim in ("max", "any"):
        return named(("x", F.max(v), "max")), lambda cut: got("x")
    if prim in ("min", "all"):
        return named(("x", F.min(v), "min")), lambda cut: got("x")
    if prim == "sum":
        return named(("s", F.sum(v), "sum")), lambda cut: got("s")
    if prim == "num_true":
        return named(("s", F.count_if(v), "sum")), lambda cut: F.coalesce(got("s"), F.lit(0)).cast("long")
    if prim in ("mean", "percent_true"):
        x = v.cast("double")
        return named(("s", F.sum(x), "sum"), ("n", F.count(x), "sum")), lambda cut: F.try_divide(got("s"), got("n"))
    if prim == "std":
        n = F.count(v).cast("double")
        parts = named(("n", n, "sum"), ("s", F.sum(v.cast("double")), "sum"), ("d", F.var_pop(v) * n, "sum"),
                      ("m", F.try_divide(F.pow(F.sum(v.cast("double")), F.lit(2.0)), n), "sum"))
        # squared deviations of all = those inside the parts + those of the parts' means
        total = F.greatest(got("d") + got("m") - F.try_divide(got("s") * got("s"), got("n")), F.lit(0.0))
        return parts, lambda cut: F.when(got("n") >= 2, F.sqrt(total / (got("n") - 1)))
    if prim in ("last", "first"):
        order = F.struct(t, F.col(f"`{key}`"), v.alias("v")) if key else F.struct(t, v.alias("v"))
        fold = F.max if prim == "last" else F.min
        return named(("o", fold(order), "max" if prim == "last" else "min")), lambda cut: got("o")["v"]
    if prim == "time_since_last":
        return named(("t", F.max(t), "max")), lambda cut: seconds_between(got("t"), cut)
    if prim == "time_since_first":
        return named(("t", F.min(t), "min")), lambda cut: seconds_between(got("t"), cut)
    if prim == "avg_time_between":
        return (named(("a", F.min(t), "min"), ("b", F.max(t), "max"), ("n", F.count(t), "sum")),
                lambda cut: F.when(got("n") >= 2, seconds_between(got("a"), got("b")) / (got("n") - 1).cast("double")))
    raise ValueError(f"{prim!r} has no state that can be merged")


def asof_aggregates(rows: DataFrame, cutoffs: DataFrame, person_key: str, time_index: str, key: str | None,
                    wanted: list[tuple[str, str | None, str]], small: bool | None = None) -> DataFrame:
    """``person_key, CUTOFF_COL`` and an output column for each (primitive, value column, name) of ``wanted``: one
    row for each row of ``cutoffs`` (columns ``person_id, cutoff_time``; repeated rows count once).

    The rows see a person's cutoffs as one sorted array, bounded by the cutoffs of that person."""
    grid = cutoffs.select(F.col("person_id").alias(person_key), F.col("cutoff_time").cast("timestamp_ntz").alias(CUTOFF_COL)).distinct()
    listed = grid.groupBy(person_key).agg(F.array_sort(F.collect_list(CUTOFF_COL)).alias("cuts"))
    seen, _ = attach_cutoff(rows, listed, person_key, cutoff_key=person_key, cutoff_time="cuts", small=small, row_key=key, cast=None)
    first = F.get(F.filter(F.col(CUTOFF_COL), lambda c: c >= F.col(f"`{time_index}`")), 0)
    seen = seen.withColumn(CUTOFF_COL, first).where(F.col(CUTOFF_COL).isNotNull())
    states, results = [], []
    for prim, value, out in wanted:
        parts, result = _state(prim, value, time_index, key, out)
        states += parts
        results.append(result(F.col(CUTOFF_COL)).alias(out))
    partial = seen.groupBy(person_key, CUTOFF_COL).agg(*[c.alias(n) for n, c, _ in states])
    before = Window.partitionBy(person_key).orderBy(CUTOFF_COL).rowsBetween(Window.unboundedPreceding, 0)
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    merged = grid.join(partial, [person_key, CUTOFF_COL], "left").select(
        person_key, CUTOFF_COL, *[fold[how](F.col(f"`{n}`")).over(before).alias(n) for n, _, how in states])
    return merged.select(person_key, CUTOFF_COL, *results)
