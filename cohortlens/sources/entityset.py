"""The table set: load from CSV or Parquet, check, save.

An ``EntitySet`` is a name, lazy DataFrames, their ``TableSpec``s and the
person→child relationships.  Loading runs no job except the optional
all-null-column check; saving runs one write job per table plus a one-row
text file with the specs, so a saved set can be loaded anywhere a Spark
session can read the folder.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import astuple, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas as S
from ..functions.scaling import recode_text
from ..operators.clean import drop_all_null_columns
from ..operators.keys import duplicate_keys, generate_key, orphan_links, split_duplicates, with_bucket
from .csv import csv_rejects, read_csv_typed

SPECS_FILE = "_specs"
META_SCHEMA = "id string, specs string, relationships string, schemas string"
RECODED = "value_recoded"


@dataclass
class EntitySet:
    id: str
    tables: dict[str, DataFrame]
    specs: dict[str, S.TableSpec]
    relationships: tuple[S.Relationship, ...] = field(default_factory=tuple)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def spec(self, name: str) -> S.TableSpec:
        return self.specs[name]

    def with_table(self, name: str, df: DataFrame, spec: S.TableSpec | None = None) -> "EntitySet":
        tables = dict(self.tables)
        tables[name] = df
        specs = dict(self.specs)
        if spec is not None:
            specs[name] = spec
        return EntitySet(self.id, tables, specs, self.relationships)

    # ---- checks ---------------------------------------------------------
    def duplicate_keys(self, name: str) -> DataFrame:
        spec = self.specs[name]
        return duplicate_keys(self.tables[name], [spec.key])

    def orphans(self, child: str) -> DataFrame:
        for r in self.relationships:
            if r.child == child:
                return orphan_links(self.tables[child], self.tables[r.parent], r.child_key, r.parent_key)
        raise KeyError(f"no relationship into {child}")

    def check(self) -> dict[str, dict[str, int]]:
        """Count duplicate keys and orphan links per table (one job each; the
        independent jobs are submitted up to four at once)."""
        report: dict[str, dict[str, int]] = {}
        jobs = []
        for name, spec in self.specs.items():
            if name not in self.tables:
                continue
            report[name] = {}
            if spec.key and spec.key in self.tables[name].columns:
                jobs.append((name, "duplicate_keys", self.duplicate_keys(name)))
            if any(r.child == name for r in self.relationships):
                jobs.append((name, "orphan_links", self.orphans(name)))
        if jobs:
            with ThreadPoolExecutor(max_workers=min(4, len(jobs))) as pool:
                counts = list(pool.map(lambda job: job[2].count(), jobs))
            for (name, what, _), n in zip(jobs, counts):
                report[name][what] = n
        return report


def _observation_recode(df: DataFrame, wide: bool) -> DataFrame:
    """Yes/No/Never answers as numbers.

    The recoded number always goes to ``value_recoded`` (the feature input).
    Wide: the raw ``value_as_number``/``value_as_string`` stay (the explorer
    shows them).  Narrow: the number itself is replaced as well and the text
    column dropped.
    """
    rec = recode_text("value_as_number", "value_as_string")
    df = df.withColumn(RECODED, rec)
    if wide:
        return df
    return df.withColumn("value_as_number", F.col(RECODED)).drop("value_as_string")


def _finish(name: str, df: DataFrame, spec: S.TableSpec, wide: bool, drop_empty: bool,
            dense_keys: bool) -> tuple[DataFrame, S.TableSpec]:
    if name == "observation":
        df = _observation_recode(df, wide)
        cols = tuple(c for c in spec.columns if wide or c.name != "value_as_string")
        spec = S.TableSpec(spec.name, cols + (S.Col(RECODED, S.NUMERIC),), spec.key,
                           spec.time_index, spec.secondary, spec.person_key, spec.generated_key)
    if drop_empty:
        # keys and all time columns stay: a delayed column's own time must not go while its values are there
        keep = tuple(c for c in (spec.key, spec.person_key, spec.time_index, *spec.secondary) if c)
        df = drop_all_null_columns(df, keep=keep)
    if spec.generated_key and spec.key not in df.columns:
        order = [c for c in df.columns]
        df = generate_key(df, spec.key, order_cols=order, dense=dense_keys)
    return df, spec


def _checked_keys(df: DataFrame, name: str, key: str, quarantine: str | None) -> DataFrame:
    once, repeated = split_duplicates(df, [key])
    if quarantine is None:
        first = repeated.select(key).head()
        if first is not None:
            raise ValueError(f"table {name!r}: key {key} = {first[0]} is repeated or null")
        return df
    repeated.write.parquet(f"{quarantine.rstrip('/')}/{name}/keys")
    return once


def load_csv(spark: SparkSession, input_dir: str, entityset_id: str = "covid",
             label: bool = True, wide: bool = True, drop_empty: bool = False,
             block_bytes: int | None = None, n_buckets: int | None = None,
             dense_keys: bool = False, tables: tuple[str, ...] | None = None,
             quoted_breaks: bool = False, quarantine: str | None = None,
             repeated_keys: str = "keep") -> EntitySet:
    """Read ``<table>.csv`` files (or folders of such files) of the health table set.

    ``wide`` keeps every known column (the explorer needs them); narrow keeps
    the feature columns.  The label table keeps all its columns.  With
    ``quarantine`` (a new folder) rows with a cell that is no value of its column, or with too few
    or too many cells, are written there, ``<table>/cells``, and left out of the table; without it such cells
    are null.  ``repeated_keys``: ``keep`` them, ``raise`` an error, or write their rows to
    ``<table>/keys`` of the quarantine and leave them out.  ``n_buckets`` adds a deterministic ``partition``
    column (hash of ``person_id``) to every table for partitioned saves.
    """
    if repeated_keys not in ("keep", "raise", "quarantine") or (repeated_keys == "quarantine" and not quarantine):
        raise ValueError(f"repeated_keys={repeated_keys!r} with quarantine={quarantine!r}")
    names = tables or tuple(n for n in S.TABLES if label or n != "goldstandard")
    out, specs = {}, {}
    for name in names:
        spec = S.TABLES[name]
        cols = [c for c in spec.column_names(wide) if not (spec.generated_key and c == spec.key)]
        file = f"{input_dir.rstrip('/')}/{name}.csv"
        df = read_csv_typed(spark, file, spec.schema(wide), columns=cols, block_bytes=block_bytes, quoted_breaks=quoted_breaks,
                            extra_columns=name == "goldstandard", drop_rejects=bool(quarantine))
        if quarantine:
            csv_rejects(spark, file, spec.schema(wide), cols, quoted_breaks=quoted_breaks).write.parquet(f"{quarantine.rstrip('/')}/{name}/cells")
        if spec.key in df.columns and repeated_keys != "keep":
            df = _checked_keys(df, name, spec.key, quarantine if repeated_keys == "quarantine" else None)
        df, spec = _finish(name, df, spec, wide, drop_empty, dense_keys)
        if n_buckets:
            df = with_bucket(df, spec.person_key if name != "person" and name != "goldstandard"
                             else spec.key, n_buckets)
        out[name], specs[name] = df, spec
    rels = tuple(r for r in S.RELATIONSHIPS if r.child in out and r.parent in out)
    return EntitySet(entityset_id, out, specs, rels)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The code dictionary (``concept_id``, ``concept_name``) from CSV or Parquet."""
    if path.endswith(".csv"):
        return read_csv_typed(spark, path, S.DATA_DICTIONARY.schema(),
                              columns=["concept_id", "concept_name"])
    return spark.read.parquet(path).select("concept_id", "concept_name")


def save(es: EntitySet, path: str, partition_by: str | None = None,
         mode: str = "errorifexists", parallel_writes: int = 4) -> None:
    """Write every table as Parquet under ``path/<table>`` plus the specs.

    The table writes are independent jobs; up to ``parallel_writes`` are
    submitted at once so the cluster is not idle at each job's tail.  The
    specs file is written last: a set without it is incomplete.
    """
    spark = next(iter(es.tables.values())).sparkSession
    base = path.rstrip("/")

    def write(item) -> None:
        name, df = item
        w = df.write.mode(mode)
        if partition_by and partition_by in df.columns:
            w = w.partitionBy(partition_by)
        w.parquet(f"{base}/{name}")

    with ThreadPoolExecutor(max_workers=max(1, min(parallel_writes, len(es.tables)))) as pool:
        for done in [pool.submit(write, item) for item in es.tables.items()]:
            done.result()   # re-raises a failed write
    doc = S.specs_to_json(es.specs)
    rels = json.dumps([list(astuple(r)) for r in es.relationships])
    # the written schemas too: loading then needs no footer-reading job per table
    schemas = json.dumps({name: T.StructType([T.StructField(f.name, f.dataType, True, f.metadata)
                                              for f in df.schema.fields]).jsonValue()
                          for name, df in es.tables.items()})
    meta = spark.createDataFrame([(es.id, doc, rels, schemas)],
                                 "id string, specs string, relationships string, schemas string")
    meta.coalesce(1).write.mode(mode).json(f"{base}/{SPECS_FILE}")


def load_parquet(spark: SparkSession, path: str, tables: tuple[str, ...] | None = None
                 ) -> EntitySet:
    """Load a set written by ``save`` (specs and relationships included)."""
    base = path.rstrip("/")
    meta = spark.read.schema(META_SCHEMA).json(f"{base}/{SPECS_FILE}").first()
    specs = S.specs_from_json(meta["specs"])
    names = tables or tuple(specs)
    written = json.loads(meta["schemas"]) if meta["schemas"] else {}

    def read(n: str) -> DataFrame:
        if n in written:
            return spark.read.schema(T.StructType.fromJson(written[n])).parquet(f"{base}/{n}")
        return spark.read.parquet(f"{base}/{n}")  # sets saved before schemas were stored

    out = {n: read(n) for n in names}
    specs = {n: specs[n] for n in names}
    rels = tuple(S.Relationship(*r) for r in json.loads(meta["relationships"] or "[]"))
    rels = tuple(r for r in rels if r.child in out and r.parent in out)
    return EntitySet(meta["id"], out, specs, rels)


def from_frames(entityset_id: str, frames: dict[str, DataFrame],
                specs: dict[str, S.TableSpec], parent: str, parent_key: str) -> EntitySet:
    """Build a set from existing DataFrames and specs (any column names)."""
    rels = tuple(S.Relationship(parent, parent_key, n, specs[n].person_key)
                 for n in frames if n != parent and specs[n].time_index)
    return EntitySet(entityset_id, dict(frames), dict(specs), rels)
