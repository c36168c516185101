"""Sharding by histogram sort: exact byte counts below probe keys, refined until the
splitters meet a tolerance, then one exchange.

Documents are ordered by (hash of the text, doc_id, row number), so equal texts lie side by side.  They are
written once with their row numbers: counts and exchange see the same rows.
``splitters`` looks for keys where the bytes below reach each target.  Each round is
one Spark job: every task counts bytes and rows per interval between the probes of all
open targets; the counts are summed by interval and the driver keeps, per target, the
interval that holds it (probes in number bounded by ``shards * parts * fanout``).
A target's splitter falls between two texts; only where a group of equal texts is so
large that this misses the target by more than ``WHOLE`` does it fall inside the group, by doc_id, and inside
rows that repeat both by row number.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import written

SHARDS = 16
TOLERANCE = 0.005  # of a shard's bytes: refinement stops here
WHOLE = 0.03  # of a shard's bytes: equal texts stay together if that costs no more
FANOUT = 32
ROUNDS = 40
_MIN, _MAX = -(2**63), 2**63 - 1

COUNTS = "level int, target int, cell int, bytes long, rows long"


def size_of(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` plus _h (hash of the text; null as its own text), _id (doc_id; null as the
    lowest) and _size."""
    return docs.withColumns({
        "_h": F.xxhash64(F.col("text").isNull(), "text"),
        "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_MIN)),
        "_size": size_of(F.col("text"))})


def _spread(lo: int, hi: int, n: int) -> list[int]:
    """At most ``n`` probes in (lo, hi]; always hi."""
    width = hi - lo
    return sorted({lo + -(-width * (i + 1) // n) for i in range(n)}) if width > 0 else []


def _histogram(keys: DataFrame, probes: dict[int, tuple[tuple[int, ...] | None, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per target: bytes and rows in the cells that its probes cut.  A target with a fixed (hash,) probes
    the ids of that text, one with a fixed (hash, id) its rows; cell i holds keys < probe i and >= probe i-1."""
    plain = {t: p for t, (h, p) in probes.items() if h is None}
    inner = {t: (h, p) for t, (h, p) in probes.items() if h is not None}
    edges = np.array(sorted({x for p in plain.values() for x in p}), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(edges) + 1), np.int64)
        within = {t: np.zeros((2, len(p) + 1), np.int64) for t, (_, p) in inner.items()}
        for batch in batches:
            h, key, row, size = (batch.column(c).to_numpy() for c in ("_h", "_id", "_row", "_size"))
            if len(edges):
                cell = np.searchsorted(edges, h, side="right")
                total[1] += np.bincount(cell, minlength=len(edges) + 1)
                order = np.argsort(cell, kind="stable")
                first = np.flatnonzero(np.diff(cell[order], prepend=-1))
                if len(first):
                    total[0][cell[order][first]] += np.add.reduceat(size[order], first)
            for t, (fixed, p) in inner.items():
                at = h == fixed[0]
                if len(fixed) > 1:
                    at &= key == fixed[1]
                cell = np.searchsorted(np.array(p, np.int64), (row if len(fixed) > 1 else key)[at], side="right")
                np.add.at(within[t][0], cell, size[at])
                np.add.at(within[t][1], cell, 1)
        rows = [(0, -1, int(c), int(total[0, c]), int(total[1, c])) for c in np.flatnonzero(total[1])]
        rows += [(1, t, int(c), int(w[0, c]), int(w[1, c])) for t, w in within.items() for c in np.flatnonzero(w[1])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (
                pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["level", "target", "cell", "bytes", "rows"])

    got = (keys.select("_h", "_id", "_row", "_size").mapInArrow(count, COUNTS)
           .groupBy("level", "target", "cell").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect())
    total = np.zeros((2, len(edges) + 1), np.int64)
    out = {t: (np.zeros(len(p) + 1, np.int64), np.zeros(len(p) + 1, np.int64)) for t, (_, p) in inner.items()}
    for r in got:
        if r.level == 0:
            total[:, r.cell] = r.bytes, r.rows
        else:
            out[r.target][0][r.cell], out[r.target][1][r.cell] = r.bytes, r.rows
    below = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(total, axis=1)], axis=1)
    for t, p in plain.items():  # sums below each probe, as cells
        at = below[:, np.searchsorted(edges, np.array(p, np.int64), side="left") + 1]
        cum = np.concatenate([at, below[:, -1:]], axis=1)
        out[t] = (np.diff(cum[0], prepend=0), np.diff(cum[1], prepend=0))
    return out


def splitters(keys: DataFrame, shards: int = SHARDS, parts: int = 1, tolerance: float = TOLERANCE,
              whole: float = WHOLE, fanout: int = FANOUT) -> list[tuple[tuple[int, int, int], int]]:
    """For each of the ``shards * parts - 1`` targets in order: ((hash, id, row), rows below it).
    A row belongs below a splitter if its (hash, id, row) is less."""
    n = shards * parts
    first = keys.agg(F.sum("_size").alias("b"), F.max("_row").alias("r")).first()
    total, end_row = first.b or 0, (first.r or 0) + 1
    stop, keep = int(tolerance * total / shards), int(whole * total / shards)
    open_ = {t: {"lo": _MIN, "hi": _MAX, "h": None, "bytes": 0, "rows": 0, "lo_sums": (0, 0), "best": (total + 1, None, 0)} for t in range(1, n)}
    done: dict[int, tuple[tuple[int, int, int], int]] = {}
    for _ in range(ROUNDS):
        if not open_ or not total:
            break
        probes = {}
        for t, s in open_.items():
            probes[t] = (s["h"], _spread(s["lo"], s["hi"], fanout))
        cells = _histogram(keys, probes)
        for t in list(open_):
            s, (h, p) = open_[t], probes[t]
            goal = total * t // n
            size, rows = cells[t]
            # sums below each probe; inside a text they start from what lies below the text
            add = (s["bytes"], s["rows"]) if h is not None else (0, 0)
            below, count = np.cumsum(size)[:-1] + add[0], np.cumsum(rows)[:-1] + add[1]
            for x, b, c in zip(p, below.tolist(), count.tolist(), strict=True):
                if abs(b - goal) < s["best"][0]:
                    s["best"] = (abs(b - goal), ((h or ()) + (x, _MIN, _MIN))[:3], c)
            over = int(np.searchsorted(below, goal, side="right"))  # the first probe with more below it
            lo = p[over - 1] if over else s["lo"]
            hi = p[over] if over < len(p) else s["hi"]
            lo_sums = (int(below[over - 1]), int(count[over - 1])) if over else s["lo_sums"]
            inner = t % parts != 0  # a range within a shard: balance is for the tasks' sake
            fine = s["best"][0] <= (stop * 8 // parts if inner else stop)
            if fine or (hi - lo <= 1 and (h is not None and len(h) > 1 or s["best"][0] <= keep)):
                done[t] = (s["best"][1], s["best"][2])
                del open_[t]
            elif hi - lo <= 1:  # one text holds the target: cut it by id; one id of it: by row
                s.update(h=(h or ()) + (lo,), lo=_MIN if h is None else -1, hi=_MAX if h is None else end_row, bytes=lo_sums[0], rows=lo_sums[1], lo_sums=lo_sums)
            else:
                s.update(lo=lo, hi=hi, lo_sums=lo_sums)
    for t, s in open_.items():
        done[t] = (s["best"][1] or (_MIN, _MIN, _MIN), s["best"][2])
    out, last = [], ((_MIN, _MIN, _MIN), 0)
    for t in range(1, n):
        last = max(last, done.get(t, last))  # splitters never go back
        out.append(last)
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, parts: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` (int, 0 .. shards-1, bytes near equal) and
    ``slot`` (long, gapless from 0 in each shard, in key order).

    ``parts`` cuts each shard further into the ranges that tasks sort; by default as many as
    the session's shuffle partitions give.  Null text has size 1; null ids come first; rows that agree in
    text and id are cut by their number, so any number of them is spread.  An empty table stays empty.
    Raises if a result column is there already."""
    spark = docs.sparkSession
    if taken := sorted(set(docs.columns) & {"shard", "slot", "_h", "_id", "_size", "_part", "_row"}):
        raise ValueError(f"columns are there already: {taken}")
    if parts is None:
        parts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    rows = written(keyed(docs).withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    cuts = splitters(rows, shards, parts, tolerance)
    cut_h = np.array([c[0][0] for c in cuts], np.int64)
    cut_key = [c[0][1:] for c in cuts]
    below = [0, *(c[1] for c in cuts)]

    @F.pandas_udf(T.IntegerType())
    def part_of(h, key, row):
        import pandas as pd

        h, key, row = h.to_numpy(np.int64), key.to_numpy(np.int64), row.to_numpy(np.int64)
        lo, hi = np.searchsorted(cut_h, h, side="left"), np.searchsorted(cut_h, h, side="right")
        out = lo.copy()
        for i in np.flatnonzero(hi > lo).tolist():  # a splitter with this very hash: compare ids and rows
            out[i] = bisect_right(cut_key, (int(key[i]), int(row[i])), int(lo[i]), int(hi[i]))
        return pd.Series(out.astype(np.int32))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = None, 0
        for batch in batches:
            p = batch.column("_part").to_numpy()
            first = np.flatnonzero(np.diff(p, prepend=-1 if part is None else part))
            start = np.zeros(len(p), np.int64)
            run = np.arange(len(p), dtype=np.int64)
            base = np.full(len(p), seen, np.int64)
            if len(first):
                start[first] = first
                start = np.maximum.accumulate(start)
                base[first[0]:] = 0
            row = run - start + base
            if len(p):
                part, seen = int(p[-1]), int(row[-1]) + 1
            start_of = np.array(below, np.int64)
            shard = p // parts
            slot = start_of[p] + row - start_of[shard * parts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(shard.astype(np.int32)), pa.array(slot)], names=[*names, "shard", "slot"])

    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return (rows.withColumn("_part", part_of("_h", "_id", "_row")).drop("_size")
            .repartition(shards * parts, "_part").sortWithinPartitions("_part", "_h", "_id", "_row")
            .drop("_h", "_id", "_row").mapInArrow(number, schema))


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The contract's columns from the sharded documents."""
    return sharded(docs.select("doc_id", "text"), shards).select(
        "doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
