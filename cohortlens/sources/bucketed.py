"""A table set stored by person bucket.

Every table is written as Parquet files hashed and sorted by its person key into one number of
buckets.  Aggregates by person, and joins of their results, then need no exchange: a bucket's task reads all rows
of its persons.  The set is registered again wherever it is loaded, so no shared metastore is
needed; the folder holds the data and one row of JSON.

The price: a person with a third of all rows makes its bucket's task the longest.  Where such persons are
expected, ``sources.save`` (whose rows are aggregated partially, wherever they lie) is the better store.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import astuple

from pyspark.sql import DataFrame, SparkSession, types as T

from .. import schemas as S
from .entityset import EntitySet

META_FILE = "_buckets"
_META = "id string, specs string, relationships string, schemas string, buckets int, keys string"


def _key(es: EntitySet, name: str) -> str:
    """The column that names the person: the parent's own key, the children's link."""
    return next((r.parent_key for r in es.relationships if r.parent == name), es.spec(name).person_key)


def save_bucketed(es: EntitySet, path: str, buckets: int) -> None:
    """Write every table into ``buckets`` buckets of its person key under the new folder ``path``."""
    spark = next(iter(es.tables.values())).sparkSession
    base, keys = path.rstrip("/"), {}
    for name, df in es.tables.items():
        keys[name] = _key(es, name)
        table = f"bucketed_{uuid.uuid4().hex}"
        # rows meet in their bucket's task before the write: one file a bucket, not one a task and bucket
        (df.repartition(buckets, keys[name]).write.bucketBy(buckets, keys[name]).sortBy(keys[name]).option("path", f"{base}/{name}")
         .mode("errorifexists").saveAsTable(table))
        spark.sql(f"DROP TABLE {table}")  # the files stay
    schemas = json.dumps({n: df.schema.jsonValue() for n, df in es.tables.items()})
    row = (es.id, S.specs_to_json(es.specs), json.dumps([list(astuple(r)) for r in es.relationships]), schemas, buckets, json.dumps(keys))
    spark.createDataFrame([row], _META).coalesce(1).write.json(f"{base}/{META_FILE}")


def load_bucketed(spark: SparkSession, path: str) -> EntitySet:
    """The set written by ``save_bucketed``."""
    base = path.rstrip("/")
    meta = spark.read.schema(_META).json(f"{base}/{META_FILE}").first()
    schemas, keys = json.loads(meta["schemas"]), json.loads(meta["keys"])

    def table(name: str) -> DataFrame:
        fields = T.StructType.fromJson(schemas[name])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        registered = f"bucketed_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {registered} ({columns}) USING parquet CLUSTERED BY (`{keys[name]}`) SORTED BY (`{keys[name]}`) "
                  f"INTO {meta['buckets']} BUCKETS LOCATION '{base}/{name}'")
        return spark.table(registered)

    return EntitySet(meta["id"], {n: table(n) for n in schemas}, S.specs_from_json(meta["specs"]),
                     tuple(S.Relationship(*r) for r in json.loads(meta["relationships"])))
