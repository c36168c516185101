"""Document fingerprints: MinHash over word shingles.

``signature`` draws ``n_hashes`` multiply-shift permutations ``(a*x + b) mod 2**64 >> 32``
over a text's distinct or repeated 5-word shingles, all in numpy.  ``near_pairs``
joins signature bands in Spark and verifies the Jaccard likeness of the shingle
sets.  ``against_neighbour`` fingerprints each text, an edited text and the next
document in descending id order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textvec as V

N_HASHES = 128
BANDS = 32
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, N_HASHES, dtype=np.uint64)
_ROWS = 512  # shingles a block: the working set stays in cache


def signature(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, N_HASHES) uint32; a text without words has all ones."""
    start, length, doc = V.words(data, offs)
    code, doc = V.shingles(V.word_hashes(data, start, length), doc)
    out = np.full((len(offs) - 1, N_HASHES), np.uint64(2**64 - 1))
    code = code >> np.uint64(32)
    work = np.empty((N_HASHES, _ROWS), np.uint64)
    for lo in range(0, len(code), _ROWS):
        x, d = code[lo:lo + _ROWS], doc[lo:lo + _ROWS]
        w = work[:, :len(x)]
        np.multiply(_A[:, None], x, out=w)
        np.add(w, _B[:, None], out=w)
        first = np.flatnonzero(np.diff(d, prepend=-1))
        ends = [*first[1:], len(x)]
        for a, b, row in zip(first, ends, d[first], strict=True):
            np.minimum(out[row], w[:, a:b].min(axis=1), out=out[row])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal components (the estimate of the Jaccard likeness)."""
    return (a == b).mean(axis=-1)


def as_hex(sig: np.ndarray) -> list[str]:
    """The low 16 bits of each component, as hexadecimal digits."""
    return [x.tobytes().hex() for x in (sig & 0xFFFF).astype(">u2")]


def _arrow(texts: list[str]) -> pa.Array:
    return pa.array(texts, pa.large_string())


def edited(text: str, other: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as many first code points of ``other``."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


def _neighbours(rows: Iterator[pa.RecordBatch], wrap: bool) -> Iterator[tuple[int, str, str]]:
    """(doc_id, text, next text) of rows sorted by bucket, carriers last.  ``wrap``: one
    bucket holds all, so its last document's next is its first."""
    bucket = held = first = None
    for batch in rows:
        cols = [batch.column(c).to_pylist() for c in ("bucket", "carrier", "doc_id", "text")]
        for b, carrier, key, text in zip(*cols, strict=True):
            text = text or ""
            if b != bucket:
                bucket, held, first = b, None, text
            if held is not None:
                yield held[0], held[1], text
            held = None if carrier else (key, text)
    if wrap and held is not None:
        yield held[0], held[1], first


OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType())])


def _digest(pending: list[tuple[int, str, str]]) -> pa.RecordBatch:
    ids, texts, others = zip(*pending, strict=True)
    changed = [edited(t, o) for t, o in zip(texts, others, strict=True)]
    sig = np.concatenate([signature(d, o) for _, _, d, o in V.blocks(_arrow([*texts, others[-1]]))])
    sig_e = np.concatenate([signature(d, o) for _, _, d, o in V.blocks(_arrow(changed))])
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array(as_hex(sig[:-1])), pa.array(as_hex(sig_e)),
        pa.array(likeness(sig[:-1], sig_e)), pa.array(likeness(sig[:-1], sig[1:]))],
        names=OUT.fieldNames())


def against_neighbour(docs: DataFrame, block_chars: int = 1 << 21) -> DataFrame:
    """Fingerprint of every text (null: empty), of its edited text (``edited`` with the
    next document in descending ``doc_id`` order, after the last the first) and their likeness.

    Null ids come last; rows of one id are ordered by text.  Equal texts have equal
    fingerprints, texts without words the all-ones one.  Other columns are ignored; an
    empty table gives no rows.

    Ids are cut into ranges (one row per range reaches the driver); the largest document
    of each range is also dealt to the range above, where it is the last one's next, so
    texts are exchanged once and no task sees more than its range.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = (docs.select("doc_id").where("doc_id is not null").repartitionByRange(n, "doc_id")
              .groupBy(F.spark_partition_id().alias("p"))
              .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect())
    low = np.array(sorted(r.lo for r in ranges)[1:], np.int64)
    high = np.array(sorted(r.hi for r in ranges), np.int64)
    n_buckets = max(1, len(high))

    @F.pandas_udf("array<int>")
    def dealt(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        key = ids.fillna(0).to_numpy(np.int64)
        b = np.where(known, np.searchsorted(low, key, side="right"), 0)
        carrier = known & np.isin(key, high) & (n_buckets > 1)
        return pd.Series([[x, (x + 1) % n_buckets] if c else [x] for x, c in zip(b.tolist(), carrier, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        for row in _neighbours(batches, n_buckets == 1):
            if pending and pending[-1][2] != row[1]:  # another range begins
                yield _digest(pending)
                pending, size = [], 0
            pending.append(row)
            size += len(row[1])
            if size >= block_chars:
                yield _digest(pending)
                pending, size = [], 0
        if pending:
            yield _digest(pending)

    dealt_rows = (docs.select("doc_id", "text").withColumn("b", dealt("doc_id"))
                  .select("doc_id", "text", F.posexplode("b").alias("carrier", "bucket")))
    return (dealt_rows.repartition(n, "bucket")
            .sortWithinPartitions("bucket", "carrier", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
            .mapInArrow(run, OUT))


SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("node", T.LongType()),
                       T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType())])


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of the shingle set), band hashes and the shingle set as bytes.
    Texts without words are left out: they are like nothing."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in V.blocks(batch.column("text")):
                sig = signature(data, offs)
                code, doc = V.shingle_sets(data, offs)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                width = N_HASHES // BANDS
                mult = V.powers(width + 2)[1:width + 1]
                band = V.mix((sig.reshape(-1, BANDS, width).astype(np.uint64) * mult).sum(axis=2, dtype=np.uint64)
                             + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                rows = [(i, code[a:b]) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo).take(pa.array([i for i, _ in rows], pa.int64())),
                    pa.array([int.from_bytes(hashlib.blake2b(c.tobytes(), digest_size=8).digest(), "little", signed=True) for _, c in rows], pa.int64()),
                    pa.array([band[i] for i, _ in rows], pa.list_(pa.int64())),
                    pa.array([c.tobytes() for _, c in rows], pa.binary())], names=SIGNED.fieldNames())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNED)


@F.pandas_udf(T.DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both))
    return pd.Series(out, dtype="float64")


def near_pairs(docs: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): class membership (doc_id, node; equal shingle sets are one
    class) and class pairs ``node_a < node_b`` that share a signature band and whose
    exact Jaccard likeness reaches ``threshold``.

    The band join is approximate by nature (32 bands of 4: a pair at 0.75 is found with
    probability 1 - (1 - 0.75**4)**32 > 0.999992).  Classes, not documents, are joined, so copies
    of a text never meet each other."""
    sig = signed(docs)
    members = sig.select("doc_id", "node")
    classes = sig.dropDuplicates(["node"])
    bands = classes.select("node", F.explode("bands").alias("band"))
    pairs = (bands.alias("a").join(bands.alias("b"), "band").where("a.node < b.node")
             .select(F.col("a.node").alias("node_a"), F.col("b.node").alias("node_b")).distinct())
    codes = classes.select("node", "codes")
    return members, (pairs.join(codes.select(F.col("node").alias("node_a"), F.col("codes").alias("ca")), "node_a")
                     .join(codes.select(F.col("node").alias("node_b"), F.col("codes").alias("cb")), "node_b")
                     .withColumn("likeness", jaccard("ca", "cb")).where(F.col("likeness") >= threshold)
                     .select("node_a", "node_b", "likeness"))
