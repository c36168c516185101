"""Feature definition files and the feature-matrix sink.

Definitions are one JSON document written as a single-row text table, so the
file lands in whatever folder Spark can write to (local, HDFS, object store).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T


def save_defs(spark: SparkSession, defs, path: str, config=None, mode: str = "errorifexists") -> None:
    from ..plans.features import defs_to_json
    doc = defs_to_json(defs, config)
    (spark.createDataFrame([(doc,)], T.StructType([T.StructField("value", T.StringType())]))
     .coalesce(1).write.mode(mode).text(path))


def load_defs(spark: SparkSession, path: str):
    from ..plans.features import defs_from_json
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return defs_from_json(text)


def write_matrix(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                 partition_by: str | None = None) -> None:
    """Write a feature matrix.  CSV cannot hold the map layout's map columns."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)
