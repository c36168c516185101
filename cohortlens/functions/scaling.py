"""Row-level transforms: age, range scaling, text-to-number recodes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .time import whole_days_between, ts_ntz

# The recodes of observation text answers.
INGEST_RECODE = {"Yes": 100.0, "No": 0.0, "Never": 0.0}      # at load, into the value column
DISPLAY_OVERRIDE = {"Yes": 1.0, "No": 0.0, "Never": 0.0}     # in the explorer's scaled value
AFFINE_CENTER = 90.0
AFFINE_SCALE = 10.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_years(dob, cutoff) -> Column:
    """Age at ``cutoff`` in 365-day years: whole elapsed days / 365, as double."""
    cut = cutoff if isinstance(cutoff, Column) else ts_ntz(cutoff)
    return whole_days_between(_col(dob), cut).cast("double") / F.lit(365.0)


def minmax_scale(value, low, high) -> Column:
    """``(value - low) / (high - low)``; a zero or null range gives null."""
    v, lo, hi = _col(value), _col(low), _col(high)
    return F.try_divide(v - lo, hi - lo)


def affine_with_overrides(value, text, center: float = AFFINE_CENTER,
                          scale: float = AFFINE_SCALE,
                          overrides: dict[str, float] | None = None) -> Column:
    """``(value - center) / scale`` unless ``text`` is one of ``overrides``."""
    overrides = DISPLAY_OVERRIDE if overrides is None else overrides
    out = (_col(value) - F.lit(float(center))) / F.lit(float(scale))
    t = _col(text)
    expr = None
    for word, num in overrides.items():
        expr = (F.when(t == word, F.lit(float(num))) if expr is None
                else expr.when(t == word, F.lit(float(num))))
    return out if expr is None else expr.otherwise(out)


def recode_text(value, text, mapping: dict[str, float] | None = None) -> Column:
    """Replace ``value`` by a number where ``text`` matches a key of ``mapping``."""
    mapping = INGEST_RECODE if mapping is None else mapping
    t = _col(text)
    expr = None
    for word, num in mapping.items():
        expr = (F.when(t == word, F.lit(float(num))) if expr is None
                else expr.when(t == word, F.lit(float(num))))
    v = _col(value).cast("double")
    return v if expr is None else expr.otherwise(v)
