"""Time visibility at a cutoff.

* time index: a row is known from its time index on (``time <= cutoff``);
* secondary time: listed columns are known only from a later time, before it
  they read as null;
* cutoff: a literal (one cutoff for everyone) or a DataFrame
  ``(person key, cutoff time)`` giving each person their own cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.time import ts_ntz
from .joins import fits_broadcast

CUTOFF_COL = "__cutoff"
SALT_COL = "__salt"


def is_per_person(cutoff) -> bool:
    return isinstance(cutoff, DataFrame)


# A per-person cutoff table up to this many rows (~16 bytes each) is broadcast:
# the child rows then stay where they are and are partially aggregated before
# any shuffle.  Larger tables are joined with salted keys.
MAX_CUTOFF_BROADCAST_ROWS = 10_000_000
CUTOFF_SALTS = 16


def cutoff_is_small(cutoff: DataFrame, max_rows: int = MAX_CUTOFF_BROADCAST_ROWS) -> bool:
    """Whether a per-person cutoff table may be broadcast (bounded count)."""
    return fits_broadcast(cutoff, max_rows)


def attach_cutoff(df: DataFrame, cutoff, person_key: str,
                  cutoff_key: str = "person_id", cutoff_time: str = "cutoff_time",
                  small: bool | None = None, row_key: str | None = None,
                  salts: int = CUTOFF_SALTS, cast: str | None = "timestamp_ntz") -> tuple[DataFrame, Column]:
    """Return ``(df, cutoff column)``.

    A per-person cutoff table (one row per person) is inner-joined on the
    person key: rows of persons without a cutoff are not asked for.  When the
    table is small (``small``, checked with a bounded count if not given) it
    is broadcast.  Otherwise each child row gets a salt in ``[0, salts)`` from
    a hash of its key (or of all its columns) and the cutoff rows are
    repeated once per salt, so a person holding a third of all rows is joined
    by ``salts`` tasks instead of one; the per-person aggregation that follows
    then shuffles partial aggregates only.
    """
    if is_per_person(cutoff):
        time = F.col(cutoff_time).cast(cast) if cast else F.col(cutoff_time)
        c = cutoff.select(F.col(cutoff_key).alias(person_key), time.alias(CUTOFF_COL))
        if small is None:
            small = cutoff_is_small(c)
        if small:
            return df.join(F.broadcast(c), person_key, "inner"), F.col(CUTOFF_COL)
        hashed = [F.col(row_key)] if row_key and row_key in df.columns else \
            [F.col(f"`{n}`") for n in df.columns]
        salted = df.withColumn(SALT_COL, F.pmod(F.xxhash64(*hashed), F.lit(salts)))
        copies = c.withColumn(SALT_COL, F.explode(F.sequence(F.lit(0).cast("long"),
                                                            F.lit(salts - 1).cast("long"))))
        joined = salted.join(copies, [person_key, SALT_COL], "inner").drop(SALT_COL)
        return joined, F.col(CUTOFF_COL)
    if cutoff is None:
        raise ValueError("a cutoff time is required (the run's clock is not used implicitly)")
    if isinstance(cutoff, str) and cutoff.lower() == "now":
        return df, F.localtimestamp()
    return df, ts_ntz(cutoff)


def visible_rows(df: DataFrame, time_index: str | None, cutoff: Column,
                 secondary: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows known at ``cutoff``, with late-known columns masked to null."""
    out = df.where(F.col(time_index) <= cutoff) if time_index else df
    if secondary:
        masked = {}
        for sec_col, cols in secondary.items():
            if sec_col not in out.columns:
                continue  # nothing says when: known with the row
            # a row that never says when (no end yet) hides nothing
            known = F.col(sec_col).isNull() | (F.col(sec_col) <= cutoff)
            for c in cols:
                if c in df.columns:
                    masked[c] = F.when(known, F.col(c))
        # all masks are computed from the unmasked columns in one projection
        out = out.withColumns(masked)
    return out
