"""Token counts as delta-maintained rollups.

A ``Rollup`` lives in a shared folder.  Each batch of changes (documents inserted, revised or
deleted) is turned into signed rows against the counts in effect: minus the old, plus the new.  The
signed rows are summed by source, language and tokenizer version, and both are written under the
batch's id before a marker commits it.  Totals are the sums of the committed deltas, so no text
is counted twice.  Committing an id again changes nothing; a batch that broke off has no marker, is not read,
and is overwritten when it is tried again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..session import scratch_path
from .byte_bpe import read_ranks
from .shared import giving_back, in_few_files, written

GROUP = ["source", "lang", "version"]
MEASURES = ["n_docs", "n_tokens", "n_chars"]
STATE = "doc_id long, source string, lang string, version string, n_docs long, n_tokens long, n_chars long"
SLICE_ROWS = 1_000  # whose texts are Python strings at a time
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long, n_chars long"


def counted(docs: DataFrame, path: str, pattern: str, version: str) -> DataFrame:
    """doc_id, source, lang, version, n_tokens, n_chars by the rank file at ``path``.  Null text
    counts as empty; a null source or language is a group of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tiktoken(path, pattern)
        for batch in batches:
            for part in (batch.slice(lo, SLICE_ROWS) for lo in range(0, batch.num_rows, SLICE_ROWS)):
                texts = [x or "" for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array([version] * len(texts), pa.string()),
                     pa.array([len(tok.encode_ordinary(x)) for x in texts], pa.int64()), pa.array(list(map(len, texts)), pa.int64())],
                    names=["doc_id", *GROUP, "n_tokens", "n_chars"])

    return docs.select(F.col("doc_id").cast("long"), "source", "lang", "text").mapInArrow(
        giving_back(run), "doc_id long, source string, lang string, version string, n_tokens long, n_chars long")


@lru_cache(maxsize=4)
def _tiktoken(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


class Rollup:
    """Totals by source, language and tokenizer version under ``root`` (a shared folder)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        found = [x.getPath() for x in fs.listStatus(p)]
        return sorted(x.getName() for x in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def _committed(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{what}/{b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def state(self) -> DataFrame:
        """The counts in effect by document: sums of its signed rows that are not undone."""
        return (self._committed("ledger", STATE).groupBy("doc_id", *GROUP).agg(*[F.sum(c).alias(c) for c in MEASURES])
                .where("n_docs <> 0"))

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens, n_chars of the groups that hold documents."""
        return (self._committed("deltas", TOTALS).groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in MEASURES]).where("n_docs <> 0"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes``: doc_id, source, lang, version, n_tokens, n_chars (the new counts) and
        ``deleted`` (null: no).  False, and nothing done, if the id is committed already.

        Of several rows of one document the one with the most tokens counts (then by characters, source, language and
        version), a deletion only if there is no other; deleting an unknown
        document and revising one to the same counts change nothing.  A row without an id is a document of its own: it
        can be added, and as nothing names it never revised or deleted.  Such rows are summed, not listed."""
        if self._exists(f"{self.root}/commits/{batch_id}/_SUCCESS"):
            return False
        # read more than once below: counted (tokenised) once, a few numbers a row
        changes = written(changes.select("doc_id", *GROUP, "n_tokens", "n_chars", "deleted"), "rollup-changes")
        unnamed = changes.where(F.col("doc_id").isNull() & ~F.coalesce("deleted", F.lit(False)))
        unnamed = unnamed.groupBy("doc_id", *GROUP).agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(c).alias(c) for c in MEASURES[1:]])
        changes = changes.where("doc_id IS NOT NULL")
        first = Window.partitionBy("doc_id").orderBy(F.coalesce("deleted", F.lit(False)), F.desc("n_tokens"), F.desc("n_chars"), *GROUP)
        new = changes.withColumn("_n", F.row_number().over(first)).where("_n = 1")
        touched = new.select(F.col("doc_id").alias("_id"))
        old = self.state().join(touched, F.col("doc_id") == F.col("_id"), "left_semi")
        minus = old.select("doc_id", *GROUP, *[(-F.col(c)).alias(c) for c in MEASURES])
        plus = new.where(~F.coalesce("deleted", F.lit(False))).select("doc_id", *GROUP, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_chars")
        signed = (minus.unionByName(plus).unionByName(unnamed).groupBy("doc_id", *GROUP).agg(*[F.sum(c).alias(c) for c in MEASURES])
                  .where("n_docs <> 0 OR n_tokens <> 0 OR n_chars <> 0"))
        ledger = f"{self.root}/ledger/{batch_id}"
        in_few_files(signed).write.mode("overwrite").parquet(ledger)
        rows = self.spark.read.schema(STATE).parquet(ledger)
        (in_few_files(rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in MEASURES]))
         .write.mode("overwrite").parquet(f"{self.root}/deltas/{batch_id}"))
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/commits/{batch_id}")
        return True


def maintained(docs: DataFrame, first: tuple[str, str], second: tuple[str, str], pattern: str, root: str | None = None) -> DataFrame:
    """Totals after a history that the documents themselves give: all are loaded under the
    tokenizer ``first`` (version, path); those not in English are revised to ``second``; all but the smallest id of each
    text are deleted; the deletion is committed once more, to no effect.  Rows without an id are loaded and stay as they are."""
    import uuid

    spark = docs.sparkSession
    docs = docs.select("doc_id", "source", "lang", "text")
    store = Rollup(spark, root or scratch_path(spark, f"rollup-{uuid.uuid4().hex}"))
    live = F.lit(False).alias("deleted")
    store.commit("1-load", counted(docs, first[1], pattern, first[0]).select("*", live))
    other = docs.where("doc_id IS NOT NULL AND NOT lang <=> 'en'")
    store.commit("2-revise", counted(other, second[1], pattern, second[0]).select("*", live))
    # copies: equal texts by length and two 64-bit hashes
    keyed = written(docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"), F.length("text").alias("c"),
                                F.col("text").isNull().alias("d")), "text-keys")
    least = keyed.groupBy("a", "b", "c", "d").agg(F.min("doc_id").alias("least"))
    cond = [keyed[c].eqNullSafe(least[c]) for c in ("a", "b", "c", "d")]
    copies = keyed.join(least, cond).where("doc_id > least").select("doc_id")
    gone = copies.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in GROUP], F.lit(0).cast("long").alias("n_tokens"),
                         F.lit(0).cast("long").alias("n_chars"), F.lit(True).alias("deleted"))
    store.commit("3-copies", gone)
    store.commit("3-copies", gone)
    return store.totals()
