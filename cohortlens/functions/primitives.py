"""Aggregate primitives as Spark ``Column`` expressions.

Every primitive is a declarative, partially-aggregatable expression: Spark
computes a partial buffer per map task and merges buffers after the shuffle,
so a person holding a third of all rows still arrives at the final aggregate
as one small buffer per task.  Ordering-dependent primitives (``last``,
``first``) use ``max_by``/``min_by`` over ``struct(time, key)`` — total order,
no window, no dependence on shuffle order.

A primitive is called as ``fn(ctx)`` with a ``PrimitiveContext`` naming the
value column, the time column, the row key and the cutoff.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, functions as F

from .time import days_since_epoch, seconds_between


@dataclass(frozen=True)
class PrimitiveContext:
    value: str | None      # input column (None for table-level primitives)
    time: str | None       # time index of the table
    key: str | None        # row key (tie-breaker for ordered primitives)
    cutoff: Column | None  # cutoff time (literal or per-row column)


def _v(ctx: PrimitiveContext) -> Column:
    return F.col(ctx.value)


def _order(ctx: PrimitiveContext) -> Column:
    parts = [F.col(ctx.time)] if ctx.time else []
    if ctx.key:
        parts.append(F.col(ctx.key))
    return F.struct(*parts)


def mean(ctx):
    return F.avg(_v(ctx))


def max_(ctx):
    return F.max(_v(ctx))


def min_(ctx):
    return F.min(_v(ctx))


def std(ctx):
    """Sample standard deviation (n-1); one value gives null."""
    return F.stddev_samp(_v(ctx))


def last(ctx):
    """Value on the row with the greatest (time, key); may be null."""
    return F.max_by(_v(ctx), _order(ctx))


def first(ctx):
    """Value on the row with the smallest (time, key); may be null."""
    return F.min_by(_v(ctx), _order(ctx))


def skew(ctx):
    """Bias-corrected sample skewness G1 (the pandas definition).

    Spark's ``skewness`` is the population g1; G1 = g1 * sqrt(n(n-1))/(n-2).
    Fewer than three values give null; three or more equal values give 0.0.
    """
    v = _v(ctx)
    n = F.count(v).cast("double")
    g1 = F.skewness(v)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.min(v) == F.max(v), F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def time_since_last(ctx):
    """Seconds from the latest row time to the cutoff."""
    return seconds_between(F.max(F.col(ctx.time)), ctx.cutoff)


def time_since_first(ctx):
    """Seconds from the earliest row time to the cutoff."""
    return seconds_between(F.min(F.col(ctx.time)), ctx.cutoff)


def count(ctx):
    """Number of rows (0 is filled in for persons without rows)."""
    return F.count(F.lit(1))


def avg_time_between(ctx):
    """Mean gap in seconds between consecutive row times: (max-min)/(n-1).

    Sorting is not needed: consecutive gaps telescope.  n < 2 gives null.
    """
    t = F.col(ctx.value or ctx.time)
    n = F.count(t)
    return F.when(n >= 2, seconds_between(F.min(t), F.max(t)) / (n - 1).cast("double"))


# ---- primitives named but disabled in the reference configuration ---------

def sum_(ctx):
    return F.sum(_v(ctx))


def num_unique(ctx):
    return F.count_distinct(_v(ctx))


def num_unique_approx(ctx):
    """Distinct values from a HyperLogLog sketch (see ``operators.sketches``): bounded buffers, no expansion of the rows."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(_v(ctx).cast("string"), F.lit(12)))


def trend(ctx):
    """Slope of a least-squares line of value against time in days."""
    return F.regr_slope(_v(ctx), days_since_epoch(F.col(ctx.time)))


def any_(ctx):
    return F.bool_or(_v(ctx))


def all_(ctx):
    return F.bool_and(_v(ctx))


def num_true(ctx):
    return F.count_if(_v(ctx))


def percent_true(ctx):
    return F.avg(_v(ctx).cast("double"))


# name -> (builder, needs a value column, default for persons without rows)
PRIMITIVES: dict[str, tuple[Callable[[PrimitiveContext], Column], bool, object]] = {
    "mean": (mean, True, None),
    "max": (max_, True, None),
    "min": (min_, True, None),
    "std": (std, True, None),
    "last": (last, True, None),
    "skew": (skew, True, None),
    "time_since_last": (time_since_last, False, None),
    "count": (count, False, 0),
    "avg_time_between": (avg_time_between, False, None),
    "time_since_first": (time_since_first, False, None),
    "sum": (sum_, True, None),
    "num_unique": (num_unique, True, 0),
    "num_unique_approx": (num_unique_approx, True, 0),
    "first": (first, True, None),
    "trend": (trend, True, None),
    "any": (any_, True, None),
    "all": (all_, True, None),
    "num_true": (num_true, True, 0),
    "percent_true": (percent_true, True, None),
}

# Primitives that only apply to numeric inputs (``last``/``first``/``mode``
# also take categorical columns).
NUMERIC_ONLY = {"mean", "max", "min", "std", "skew", "sum", "trend"}
# ``median`` and ``mode`` are not single aggregates here: Spark's built-in ones
# keep every distinct value of a group in one buffer.  They are two-phase
# operators in ``operators.grouping`` (``grouped_median``, ``grouped_mode``).
BOOLEAN_ONLY = {"any", "all", "num_true", "percent_true"}


def primitive(name: str, value: str | None = None, time: str | None = None,
              key: str | None = None, cutoff: Column | None = None) -> Column:
    """Build one aggregate Column by primitive name."""
    fn, _, _ = PRIMITIVES[name]
    return fn(PrimitiveContext(value, time, key, cutoff))


def default_for(name: str):
    return PRIMITIVES[name][2]
