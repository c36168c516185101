"""Prolonged contacts over arriving sighting files.

The batch question of ``operators.contacts`` as a stream: later and earlier sightings are joined within
``near`` seconds under a watermark, and a session window of ``gap`` seconds groups a pair's moments.  A session is
written when the watermark has passed its end, so its rows are final.  All state lies beside the
output (``_state``): a restarted stream goes on where it stopped, and the file sink's log
keeps a replayed micro-batch from being written twice.

A session stays open until the watermark passes it.  ``close_sightings`` adds a file with one marker row, far in
the future at a place that nobody visits; the run that reads it writes every open session, and
the output then equals the batch result over the rows that were not late.  Rows that come behind the watermark
(``lateness`` before the latest time seen) are dropped by the join and counted in ``_late``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.contacts import LEAST_SECONDS, cell_of, micros, session_columns

MARKER_PLACE = "__end__"
MARKER_PERSON = "__end__"
SIGHTING = T.StructType([T.StructField("person", T.StringType()), T.StructField("place", T.StringType()), T.StructField("time", T.TimestampNTZType())])
_COPIES = 3  # a late row is dropped once as the later sighting and twice (two cells) as the earlier one


def close_sightings(spark: SparkSession, landing_dir: str, until: dt.datetime) -> None:
    """Add the marker file: its row lies at ``until``, which must be later than any session can end."""
    marker = spark.createDataFrame([(MARKER_PERSON, MARKER_PLACE, until)], SIGHTING)
    marker.coalesce(1).write.mode("append").parquet(landing_dir)


def _moments(spark: SparkSession, landing_dir: str, near: float, lateness: str, files: int | None) -> DataFrame:
    def read() -> DataFrame:
        reader = spark.readStream.schema(SIGHTING)
        if files:
            reader = reader.option("maxFilesPerTrigger", str(files))
        rows = reader.parquet(landing_dir).where("person IS NOT NULL AND place IS NOT NULL AND time IS NOT NULL")
        # the clock's time as an instant, whatever the session's time zone: watermarks need instants
        rows = rows.withColumn("us", micros(F.col("time"))).withColumn("time", F.timestamp_micros("us"))
        return rows.withColumn("cell", cell_of(F.col("us"), int(near * 1_000_000)))

    later = read().select(F.col("person").alias("q"), F.col("place").alias("at"), F.col("cell").alias("c"), F.col("time").alias("t")).withWatermark("t", lateness)
    earlier = read().select(F.col("person").alias("p"), "place", F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"),
                            F.col("us").alias("earlier"), F.col("time").alias("t0")).withWatermark("t0", lateness)
    met = later.join(earlier, (F.col("at") == F.col("place")) & (F.col("c") == F.col("cell")) & (F.col("p") != F.col("q")) & (F.col("t0") <= F.col("t"))
                     & (F.col("t") <= F.col("t0") + F.expr(f"INTERVAL {int(near)} SECONDS")))
    met = met.where((F.col("t0") < F.col("t")) | (F.col("p") < F.col("q")))
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "t", "earlier")


def stream_contacts(spark: SparkSession, landing_dir: str, out_dir: str, near: float, gap: float, lateness: str,
                    least: float = LEAST_SECONDS, files: int | None = None) -> int:
    """Read what has arrived (Parquet files of ``person, place, time``), write the sessions that are over, and
    return how many rows were late in this run."""
    if gap <= near:
        raise ValueError("the gap that ends a session must be longer than what counts as near")
    met = _moments(spark, landing_dir, near, lateness, files)
    window = F.session_window("t", f"{int(gap)} seconds")
    found = met.groupBy("a", "b", window).agg(F.min("earlier").alias("first"), F.max(F.unix_micros("t")).alias("last"), F.count(F.lit(1)).alias("n"))
    found = found.where(F.col("last") - F.col("first") > int(least * 1_000_000)).select("a", "b", *session_columns("first", "last", "n"))
    base = out_dir.rstrip("/")
    query = (found.writeStream.format("parquet").option("checkpointLocation", f"{base}/_state").outputMode("append")
             .trigger(availableNow=True).start(f"{base}/sessions"))
    dropped: dict[int, int] = {}
    while True:  # progress is kept for the last batches only: look while the run goes on
        over = query.awaitTermination(1)
        for p in query.recentProgress:
            n = sum(s.numRowsDroppedByWatermark for s in p.stateOperators if s.operatorName == "symmetricHashJoin")
            dropped[p.batchId] = max(n, dropped.get(p.batchId, 0))
        if over or over is None:
            break
    if dropped:
        first, last = min(dropped), max(dropped)
        rows = [(b, n // _COPIES) for b, n in sorted(dropped.items())]
        spark.createDataFrame(rows, "batch long, late_rows long").coalesce(1).write.mode("overwrite").parquet(f"{base}/_late/batches={first}-{last}")
    return sum(n // _COPIES for n in dropped.values())


def read_contacts(spark: SparkSession, out_dir: str) -> DataFrame:
    """The sessions written so far."""
    return spark.read.parquet(f"{out_dir.rstrip('/')}/sessions")
