"""URL filters: a Bloom filter cascade over a complete key universe, under path rules.

``Cascade.build`` takes the universe's distinct keys with a flag (listed or not).
Level 1 holds the listed keys, level 2 the unlisted keys that level 1 lets through
(its false positives), level 3 the listed keys that level 2 lets through, and so on until
none is left.  A key of the universe is listed iff the first level that lacks it is an even
one: exact, without a join.

Keys are cut by hash into shards, each built in one task from its own distinct keys, so
no filter depends on all of them.  A shard's levels take about 1.5 bytes per listed key plus what
the false positives need.  To judge rows, shards are broadcast in blocks of at most
``BLOCK_BYTES``: each row is judged in the one pass that holds its shard.  A list that fits
one block takes one pass; a larger one takes more passes, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import written

BLOCK_BYTES = 64 << 20
SHARD_KEYS = 1 << 20
BITS_PER_KEY = 12
N_HASHES = 8
MAX_LEVELS = 40
#: Labels whose hosts the default list blocks.
LISTED_LABELS = ("cheap-pills", "casino", "viagra", "lottery", "payday", "replica", "adult", "xxx")
#: Fixed values: (host, path, verdict), longest first when judged.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without
    that or for null, empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty where ``host_of`` finds no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_index(host: Column, path: Column, rules=RULES) -> Column:
    """Place in ``rules`` of the longest rule (host and path together) that fits, else null."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0] + rules[i][1]), i))
    out = F.lit(None).cast("int")
    for i in reversed(order):
        h, p, _ = rules[i]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


# -- cascade ---------------------------------------------------------------

def _slots(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
    """(keys, N_HASHES) bit numbers of a level, by double hashing of two 64-bit hashes."""
    a = a.view(np.uint64) ^ np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    b = b.view(np.uint64) * np.uint64(2 * level + 1) | np.uint64(1)
    return (((a[:, None] + b[:, None] * np.arange(N_HASHES, dtype=np.uint64)) >> np.uint64(16)) % np.uint64(bits)).astype(np.int64)


def _contains(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7) & 1).all(axis=1)


def build_levels(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> list[np.ndarray]:
    """Bitmaps of the levels for distinct keys with hashes ``a`` and ``b``."""
    inside, outside, levels = np.flatnonzero(listed), np.flatnonzero(~listed), []
    while len(inside):
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("two keys agree in both 64-bit hashes")
        bits = 64 + BITS_PER_KEY * len(inside)
        bitmap = np.zeros(-(-bits // 8), np.uint8)
        s = _slots(a[inside], b[inside], len(levels), bits).ravel()
        np.bitwise_or.at(bitmap, s >> 3, (1 << (s & 7)).astype(np.uint8))
        passed = outside[_contains(bitmap, _slots(a[outside], b[outside], len(levels), bits))] if len(outside) else outside
        levels.append((bits, bitmap))
        inside, outside = passed, inside
    return levels


def member(levels: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Is each key listed?  Exact for keys of the universe."""
    out = np.zeros(len(a), bool)
    left = np.arange(len(a))
    for i, (bits, bitmap) in enumerate(levels):
        has = _contains(bitmap, _slots(a[left], b[left], i, bits))
        out[left[~has]] = i % 2 == 1
        left = left[has]
    out[left] = len(levels) % 2 == 1  # passed all: as the last level's own keys
    return out


def _hashed(df: DataFrame, key: Column, shards: int) -> DataFrame:
    return df.withColumns({"_a": F.xxhash64(key), "_b": F.xxhash64(key, F.lit(1))}).withColumn(
        "_shard", F.pmod(F.xxhash64(key, F.lit(2)), F.lit(shards)).cast("int"))


CASCADE = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("bits", T.ArrayType(T.LongType())),
                        T.StructField("maps", T.ArrayType(T.BinaryType())), T.StructField("bytes", T.LongType())])


def build(universe: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(cascade table, shards) from distinct keys ``key`` (not null) with ``listed`` (boolean).

    A key listed in any row counts as listed; repeated keys are merged first (on the map
    side).  A shard without a listed key has no levels: nothing is listed."""
    keys = written(universe.groupBy("key").agg(F.max("listed").alias("listed")), "url-universe")
    shards = max(1, -(-keys.count() // shard_keys))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = build_levels(pdf["_a"].to_numpy(np.int64), pdf["_b"].to_numpy(np.int64), pdf["listed"].to_numpy(bool))
        return pd.DataFrame({"shard": [int(pdf["_shard"].iloc[0])], "bits": [[x for x, _ in levels]],
                             "maps": [[m.tobytes() for _, m in levels]], "bytes": [sum(len(m) for _, m in levels)]})

    table = (_hashed(keys, F.col("key"), shards).select("_shard", "_a", "_b", "listed")
             .groupBy("_shard").applyInPandas(one, CASCADE))
    return written(table, "url-cascade"), shards


def _blocks(sizes: list[tuple[int, int]], limit: int) -> list[list[int]]:
    out, used = [[]], 0
    for shard, size in sorted(sizes):
        if out[-1] and used + size > limit:
            out.append([])
            used = 0
        out[-1].append(shard)
        used += size
    return out


def flag(df: DataFrame, key: str, cascade: DataFrame, shards: int, name: str = "listed", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` plus ``name`` (boolean): is the row's key listed?  Keys must belong to the
    universe the cascade was built over; a null key is not listed."""
    spark = df.sparkSession
    keep = df.columns
    hashed = _hashed(df, F.col(f"`{key}`"), shards)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())])
    groups = _blocks([(r.shard, r.bytes) for r in cascade.select("shard", "bytes").collect()], block_bytes)
    out = None
    for i, group in enumerate(groups):
        rows = cascade.where(F.col("shard").isin(group)).collect() if group else []
        held = spark.sparkContext.broadcast(
            {r.shard: [(b, np.frombuffer(m, np.uint8)) for b, m in zip(r.bits, r.maps, strict=True)] for r in rows})

        def judge(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard, a, b = (batch.column(c).to_numpy() for c in ("_shard", "_a", "_b"))
                hit = np.zeros(len(shard), bool)
                for s in np.unique(shard):
                    if (levels := held.value.get(int(s))) is not None:
                        at = np.flatnonzero(shard == s)
                        hit[at] = member(levels, a[at], b[at])
                known = np.asarray(batch.column(key).is_valid())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(hit & known)], names=[*keep, name])

        # a pass takes the shards of its block; the first also those without any listed key
        mine = F.col("_shard").isin(group) if i else ~F.col("_shard").isin([s for g in groups[1:] for s in g])
        part = hashed.where(mine).mapInArrow(judge, schema)
        out = part if out is None else out.unionByName(part)
    return out


def listed_host(host: Column, labels=LISTED_LABELS) -> Column:
    """The default list: hosts with one of ``labels`` among their labels."""
    return F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, labels)))


def judged(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    The longest fitting rule decides; else a host in ``listed`` (column ``host``; by default the
    corpus's hosts with a listed label) is blocked through the cascade, all others allowed.
    Null urls and urls without ``://`` have an empty host and path and are allowed."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = parsed.select(F.col("host").alias("key"))
    if listed is None:
        universe = hosts.select("key", listed_host(F.col("key")).alias("listed"))
    else:
        universe = hosts.select("key", F.lit(False).alias("listed")).unionByName(
            listed.where("host is not null").select(F.col("host").alias("key"), F.lit(True).alias("listed")))
    cascade, shards = build(universe)
    hit = flag(parsed, "host", cascade, shards, "_listed")
    names, verdicts = (F.array(*[F.lit(x) for x in xs]) for xs in ([h + p for h, p, _ in rules], [v for *_, v in rules]))
    hit = hit.withColumn("_rule", rule_index(F.col("host"), F.col("path"), rules))
    return hit.select("page_id", "host", "path", F.get(names, F.col("_rule")).alias("rule"),
                      F.coalesce(F.get(verdicts, F.col("_rule")), F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"))


def judged_sql(rules=RULES, labels=LISTED_LABELS) -> str:
    """DuckDB SQL for ``judged`` with the default list."""
    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in order]
    case = lambda k: " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits)
    words = ", ".join(f"'{x}'" for x in labels)
    return rf"""
WITH p AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {case(1)} END AS rule,
    CASE {case(2)} WHEN list_has_any(string_split(host, '.'), [{words}]) THEN 'block' ELSE 'allow' END AS verdict
FROM p"""
