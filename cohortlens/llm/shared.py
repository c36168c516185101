"""Written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import scratch_path


def in_few_files(df: DataFrame) -> DataFrame:
    """``df`` with at most one task and so one file for each core: for tables whose last step is cheap, as many small
    files cost more than their rows."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read again: later
    jobs neither recompute it nor depend on one executor's files.  ``few``: ``in_few_files``."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    (in_few_files(df) if few else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others need none
    if trim is not None:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """``run`` (for mapInArrow), which ends with a ``release``: a Python worker outlives its task and waits for a later one,
    beside others, with all the memory that its allocators keep."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
