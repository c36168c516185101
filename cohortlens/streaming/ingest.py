"""Incremental table-set load with Structured Streaming.

The batch loader reads every ``<table>.csv`` once.  When extracts arrive as
files over time, the same typed conversion runs as a stream: each new CSV
file in a landing folder is read with the table's fixed layout, converted
(``try_cast``, time parsing, Yes/No recode), and appended to the Parquet
table.  Every micro-batch is written to its own ``batch=<id>`` folder with
``overwrite``, so a micro-batch replayed after a lost executor or driver
restart replaces its own output instead of duplicating it.  Per batch, the
duplicate-key and orphan-link counts are appended to ``_checks/<table>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators.keys import duplicate_keys, generate_key, orphan_links
from ..sources.csv import convert
from ..sources.entityset import _observation_recode


def _typed(raw: DataFrame, spec: S.TableSpec, wide: bool) -> DataFrame:
    types = {f.name: f.dataType for f in spec.schema(wide).fields}
    out = [convert(F.col(c), types[c]).alias(c) for c in raw.columns if c in types]
    df = raw.select(*out)
    if spec.name == "observation":
        df = _observation_recode(df, wide)
    return df


def stream_table(spark: SparkSession, name: str, landing_dir: str, out_dir: str,
                 file_columns: list[str] | None = None, wide: bool = True,
                 person_path: str | None = None, checkpoint: str | None = None,
                 available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start (and with ``available_now`` drain) the stream for one table.

    ``file_columns`` is the column order of the arriving files (default: the
    table's layout); headers are validated against it.  ``person_path`` is
    the Parquet person table used for the orphan-link count.
    Returns the ``StreamingQuery``.
    """
    spec = S.TABLES[name]
    cols = file_columns or [c for c in spec.column_names(wide)
                            if not (spec.generated_key and c == spec.key)]
    text_schema = T.StructType([T.StructField(c, T.StringType(), True) for c in cols])
    reader = (spark.readStream.schema(text_schema).option("header", "true")
              .option("enforceSchema", "false"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    typed = _typed(reader.csv(landing_dir), spec, wide)
    base = out_dir.rstrip("/")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        df = batch
        if spec.generated_key and spec.key not in df.columns:
            # dense within the batch, offset by the batch id: unique across
            # batches and identical when the batch is replayed
            df = generate_key(df, spec.key, dense=True).withColumn(
                spec.key, F.col(spec.key) + F.lit(batch_id).cast("long") * F.lit(1 << 40))
        path = f"{base}/{name}/batch={batch_id}"
        df.write.mode("overwrite").parquet(path)
        # checks read the written batch back instead of re-parsing the CSV
        df = df.sparkSession.read.parquet(path)
        dups = duplicate_keys(df, [spec.key]).count() if spec.key else 0
        orphans = 0
        if person_path and name not in ("person", "goldstandard"):
            person = df.sparkSession.read.parquet(person_path)
            orphans = orphan_links(df, person, spec.person_key, "person_id").count()
        (df.sparkSession.createDataFrame(
            [(int(batch_id), name, int(dups), int(orphans))],
            "batch_id long, table string, duplicate_keys long, orphan_links long")
         .write.mode("overwrite").parquet(f"{base}/_checks/{name}/batch={batch_id}"))

    # beside the output: a restart in another session goes on where this one stopped
    ckpt = checkpoint or f"{base}/_state/{name}"
    w = typed.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def read_streamed(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """The appended table (all batches), without the batch folder column."""
    return spark.read.parquet(f"{out_dir.rstrip('/')}/{name}").drop("batch")
