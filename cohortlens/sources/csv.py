"""Typed CSV scans of one or many files.

Every file has a header of its own: files are grouped by header (read from each file's first line) and each
group is scanned with its own columns, so a column is found by its name wherever it stands.  Columns are
scanned as text and converted with ``try_cast`` to the fixed type of their role: a malformed cell
becomes null instead of failing the job, and the row can be listed with the cells that failed
(``csv_rejects``) or kept out of the table.  Only the requested columns are converted; Spark's CSV reader prunes the rest.

Quotes inside a quoted cell are doubled.  Cells that say "missing" (``MISSING``) are null, in text
columns too.  A cell with a line break needs ``quoted_breaks``; such files are read whole by one task each, others are split.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

# Timestamp shapes accepted besides ISO-8601 (which a plain cast handles).
EXTRA_TIME_FORMATS = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "yyyyMMdd")

# Texts that the pandas CSV reader takes for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
           "NULL", "NaN", "None", "n/a", "nan", "null")

DEFAULT_BLOCK = 40 * 1024 * 1024
HEADER_READERS = 8
_WHOLE = T.DecimalType(38, 10)


def to_timestamp_ntz(c: Column) -> Column:
    """Parse text as ``timestamp_ntz``: ISO first, then the extra formats."""
    parsed = [c.try_cast("timestamp_ntz")]
    parsed += [F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz") for fmt in EXTRA_TIME_FORMATS]
    return F.coalesce(*parsed)


def present(c: Column) -> Column:
    """The cell's text, null where it says that a value is missing."""
    return F.when(~F.trim(c).isin(*MISSING), c)


def convert(c: Column, dtype: T.DataType) -> Column:
    c = present(c)
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.TimestampNTZType):
        return to_timestamp_ntz(c)
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType)):
        # codes written as 8507.0 or 1e3 by a tool that knew them as floats
        number = c.try_cast(_WHOLE)
        return F.coalesce(c.try_cast(dtype), F.when(number == F.floor(number), number).try_cast(dtype))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        number = c.try_cast(dtype)
        return F.when(~F.isnan(number), number)
    return c.try_cast(dtype)


def _options(quoted_breaks: bool, options: dict | None) -> dict:
    opts = {"header": "true", "mode": "PERMISSIVE", "quote": '"', "escape": '"', "multiLine": str(quoted_breaks).lower(),
            "enforceSchema": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return opts | (options or {})


def _reader_session(spark: SparkSession, block_bytes: int | None) -> SparkSession:
    """The session that scans: with a block size a session of its own, so the caller's settings stay."""
    if not block_bytes:
        return spark
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def headers(spark: SparkSession, path: str, options: dict) -> dict[tuple[str, ...], list[str]]:
    """The files under ``path`` by their header.  One short read of each file's first line; files are few and large."""
    files = sorted(spark.read.text(path).inputFiles())
    found: dict[tuple[str, ...], list[str]] = {}
    if files:
        with ThreadPoolExecutor(max_workers=min(HEADER_READERS, len(files))) as pool:
            for file, names in zip(files, pool.map(lambda f: tuple(spark.read.options(**options).csv(f).columns), files), strict=True):
                if names:  # an empty file has no header and no rows
                    found.setdefault(names, []).append(file)
    return found


_BROKEN = "__broken_record"


def _raw(spark: SparkSession, path: str, wanted: list[str] | None, block_bytes: int | None, options: dict, checked: bool) -> DataFrame:
    """The files' cells as text: ``wanted`` columns (default: all, as first seen), null where a file lacks one.  With ``checked``
    also the file and, of rows with too few or too many cells, the line."""
    reader = _reader_session(spark, block_bytes)
    groups = headers(spark, path, options)
    wanted = wanted or list(dict.fromkeys(n for names in groups for n in names))
    extra = ["__file", _BROKEN] if checked else []
    out = None
    for names, files in groups.items():
        fields = [T.StructField(n, T.StringType(), True) for n in names]
        scan = reader.read.options(**options)
        if checked:
            fields.append(T.StructField(_BROKEN, T.StringType(), True))
            # cells are only counted where none is pruned
            scan = scan.option("columnNameOfCorruptRecord", _BROKEN).option("columnPruning", "false")
        df = scan.schema(T.StructType(fields)).csv(files)
        cells = [(F.col(f"`{n}`") if n in names else F.lit(None).cast("string")).alias(n) for n in wanted]
        df = df.select(*cells, *([F.col("_metadata.file_path").alias("__file"), _BROKEN] if checked else []))
        out = df if out is None else out.unionByName(df)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType(), True) for n in [*wanted, *extra]]))
    return out


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType,
                   columns: list[str] | None = None, block_bytes: int | None = None,
                   options: dict | None = None, quoted_breaks: bool = False, extra_columns: bool = False,
                   drop_rejects: bool = False) -> DataFrame:
    """Read the files under ``path``, keep ``columns`` (default: all of ``schema``), typed by ``schema``.

    Columns that a file lacks read null; ``extra_columns`` keeps those that the schema does not name, as
    text.  With ``drop_rejects`` rows that ``csv_rejects`` lists are left out."""
    opts = _options(quoted_breaks, options)
    types = {f.name: f.dataType for f in schema.fields}
    wanted = list(columns or types)
    if extra_columns:
        wanted += [n for names in headers(spark, path, opts) for n in names if n not in wanted and n not in types]
        wanted = list(dict.fromkeys(wanted))
    raw = _raw(spark, path, wanted, block_bytes, opts, drop_rejects)
    if drop_rejects:
        raw = raw.where(F.size(_failed(wanted, types)) == 0)
    return raw.select(*[convert(F.col(f"`{n}`"), types.get(n, T.StringType())).alias(n) for n in wanted])


def _failed(columns: list[str], types: dict[str, T.DataType]) -> Column:
    """Names of the columns whose cell says something that is no value of the column's type."""
    bad = [F.when(present(F.col(f"`{n}`")).isNotNull() & convert(F.col(f"`{n}`"), types[n]).isNull(), F.lit(n))
           for n in columns if n in types and not isinstance(types[n], T.StringType)]
    bad.append(F.when(F.col(_BROKEN).isNotNull(), F.lit("(cells)")))
    return F.filter(F.array(*bad), lambda x: x.isNotNull())


def csv_rejects(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None,
                options: dict | None = None, quoted_breaks: bool = False) -> DataFrame:
    """``file, failed, cells, line`` of each row with a cell that failed to convert, or with too few or
    too many cells (then ``failed`` holds ``(cells)`` and ``line`` the text)."""
    types = {f.name: f.dataType for f in schema.fields}
    wanted = list(columns or types)
    raw = _raw(spark, path, wanted, None, _options(quoted_breaks, options), True)
    cells = F.map_from_arrays(F.array(*map(F.lit, wanted)), F.array(*[F.col(f"`{n}`") for n in wanted]))
    rows = raw.select(F.col("__file").alias("file"), _failed(wanted, types).alias("failed"), cells.alias("cells"), F.col(_BROKEN).alias("line"))
    return rows.where(F.size("failed") > 0)


def reject_counts(spark: SparkSession, path: str, schema: T.StructType,
                  columns: list[str] | None = None, options: dict | None = None) -> dict[str, int]:
    """Per column, how many cells failed to convert (one pass)."""
    types = {f.name: f.dataType for f in schema.fields}
    cols = [c for c in (columns or types) if c in types and not isinstance(types[c], T.StringType)]
    if not cols:
        return {}
    raw = _raw(spark, path, cols, None, _options(False, options), False)
    row = raw.agg(*[F.count_if(present(F.col(f"`{c}`")).isNotNull() & convert(F.col(f"`{c}`"), types[c]).isNull()).alias(c) for c in cols]).first()
    return {c: int(row[c]) for c in cols}
