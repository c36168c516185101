"""Fitted encoding state, stored with the definitions it belongs to.

What one-hot encoding and min-max scaling learn from a table (kept categories, ranges) is one versioned JSON
document.  Applied to another table it runs no job and gives the same columns: categories that are new
there count as unknown, values outside a range scale beyond 0 and 1.  The document names a digest of
the feature definitions; applying it to others is refused.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scaling import minmax_scale
from ..operators.encode import DEFAULT_TOP_N, one_hot

VERSION = 1
_READ = {"int": int, "str": str, "bool": lambda x: x, "float": float, "Decimal": decimal.Decimal,
         "date": dt.date.fromisoformat, "datetime": dt.datetime.fromisoformat}


def _written(value) -> list:
    kind = type(value).__name__
    if kind not in _READ:
        raise TypeError(f"no category of type {kind}")
    return [kind, value if kind in ("int", "str", "bool") else repr(value) if kind == "float" else value.isoformat() if kind in ("date", "datetime") else str(value)]


def definitions_digest(defs) -> str:
    """Digest of a definition list."""
    from ..plans.features import defs_to_json
    return hashlib.sha256(defs_to_json(list(defs)).encode()).hexdigest()


@dataclass(frozen=True)
class Encoding:
    categories: dict[str, list] = field(default_factory=dict)
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    definitions: str = ""
    version: int = VERSION

    def apply(self, df: DataFrame, defs=None, scaled: str = "{}__scaled") -> DataFrame:
        """One-hot columns in place of the categories' columns, and a scaled column for each range.  No job is run."""
        if defs is not None and self.definitions != definitions_digest(defs):
            raise ValueError("the encoding was fitted for other feature definitions")
        missing = [c for c in (*self.categories, *self.ranges) if c not in df.columns]
        if missing:
            raise ValueError(f"the table has no column {missing[0]!r}")
        df = df.withColumns({scaled.format(c): minmax_scale(F.col(c), F.lit(lo).cast("double"), F.lit(hi).cast("double")) for c, (lo, hi) in self.ranges.items()})
        return one_hot(df, list(self.categories), values=self.categories)[0]


def fit_encoding(df: DataFrame, categorical: list[str], numeric: list[str] = (), top_n: int = DEFAULT_TOP_N, defs=None) -> Encoding:
    """Learn the ``top_n`` categories (by count, ties by value) and the ranges of a table."""
    categories = one_hot(df, list(categorical), top_n=top_n)[1]
    ranges = {}
    if numeric:
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in numeric for n, f in (("lo", F.min), ("hi", F.max))]).first()
        ranges = {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in numeric}
    return Encoding({c: categories[c] for c in categorical}, ranges, definitions_digest(defs) if defs is not None else "")


def save_encoding(spark: SparkSession, encoding: Encoding, path: str, mode: str = "errorifexists") -> None:
    body = {"version": encoding.version, "definitions": encoding.definitions, "ranges": {c: list(r) for c, r in encoding.ranges.items()},
            "categories": {c: [_written(v) for v in values] for c, values in encoding.categories.items()}}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode(mode).text(path)


def load_encoding(spark: SparkSession, path: str) -> Encoding:
    body = json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    if body["version"] != VERSION:
        raise ValueError(f"encoding version {body['version']} is not {VERSION}")
    return Encoding({c: [_READ[k](v) for k, v in values] for c, values in body["categories"].items()},
                    {c: tuple(r) for c, r in body["ranges"].items()}, body["definitions"])
