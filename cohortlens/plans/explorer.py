"""Per-person views: profile, event timeline, scaled measurements.

Each view works for one person (the equality filter is pushed to the Parquet
scan) or for all persons (``person_id=None``; the person key is kept so the
rows stay attributable).  The tables of a view are stacked first, then joined once to the code
dictionary; unknown codes read ``'NA'``.  Building a view runs no job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.scaling import affine_with_overrides, minmax_scale, DISPLAY_OVERRIDE
from ..operators.clean import fill_missing, union_by_name
from ..operators.joins import attach_status, lookup_join
from ..sources.entityset import EntitySet


@dataclass(frozen=True)
class Facet:
    """How one child table maps onto the shared view columns."""
    table: str
    facet: str
    concept: str                       # code column looked up in the dictionary
    columns: dict[str, str]            # output name -> source column
    y_from_concept_name: bool = False  # Y = looked-up name (before 'NA' fill)
    scale: str | None = None           # "minmax" | "affine" | None
    scale_args: dict = field(default_factory=dict)


# The view columns and their sources in the health table set.
TIMELINE_FACETS = (
    Facet("condition_occurrence", "condition_occurrence", "condition_concept_id", {
        "start_datetime": "condition_start_datetime", "end_datetime": "condition_end_datetime",
        "Y": "condition_status_source_value"}),
    Facet("drug_exposure", "drug_exposure", "drug_concept_id", {
        "start_datetime": "drug_exposure_start_datetime", "end_datetime": "drug_exposure_end_datetime",
        "refills": "refills", "quantity": "quantity", "days_supply": "days_supply",
        "stop_reason": "stop_reason", "Y": "route_source_value",
        "dose_unit_source_value": "dose_unit_source_value"}),
    Facet("visit_occurrence", "visit_occurrence", "visit_concept_id", {
        "start_datetime": "visit_start_datetime", "end_datetime": "visit_end_datetime"},
        y_from_concept_name=True),
)

MEASUREMENT_FACETS = (
    Facet("measurement", "measurement", "measurement_concept_id", {
        "datetime": "measurement_datetime", "range_low": "range_low", "range_high": "range_high",
        "value_as_number": "value_as_number", "unit_source_value": "unit_source_value"},
        scale="minmax", scale_args={"value": "value_as_number", "low": "range_low",
                                    "high": "range_high"}),
    Facet("observation", "observation", "observation_concept_id", {
        "datetime": "observation_datetime", "value_as_number": "value_as_number",
        "value_as_string": "value_as_string", "unit_source_value": "unit_source_value"},
        scale="affine", scale_args={"value": "value_as_number", "text": "value_as_string"}),
)

PROFILE_COLUMNS = ("status", "birth_datetime", "gender_source_value")


def _for_person(df: DataFrame, person_key: str, person_id) -> DataFrame:
    return df if person_id is None else df.where(F.col(person_key) == F.lit(person_id))


def patient_info(es: EntitySet, person_id=None, person: str = "person",
                 label: str = "goldstandard", columns=PROFILE_COLUMNS) -> DataFrame:
    """Profile rows: label status and person columns (one person or all)."""
    key = es.spec(person).key
    p = _for_person(es[person], key, person_id)
    if label in es:
        lab = _for_person(es[label], key, person_id).select(key, "status")
        p = attach_status(p, lab, key)
    else:
        p = p.withColumn("status", F.lit(None).cast("long"))
    return p.select(key, *columns)


CODE = "__concept"


def _facet_rows(es: EntitySet, f: Facet, person_id, time_range=None, start_col: str | None = None,
                end_col: str | None = None) -> DataFrame:
    """A table's rows in the view's columns, with its code still to be looked up."""
    spec = es.spec(f.table)
    pk = spec.person_key
    df = _for_person(es[f.table], pk, person_id)
    if time_range is not None and start_col and end_col:
        lo, hi = time_range
        s, e = F.col(f.columns[start_col]), F.col(f.columns[end_col])
        df = df.where((s <= F.lit(hi).cast("timestamp_ntz"))
                      & (F.coalesce(e, s) >= F.lit(lo).cast("timestamp_ntz")))
    types = {c.name: c.spark_type() for c in spec.columns}

    def col(name: str):
        # a column dropped at load (all null) reads as a typed null
        if name in df.columns:
            return F.col(name)
        return F.lit(None).cast(types.get(name, "string"))

    cols = [F.col(pk).alias("person_id")]
    cols += [col(src).alias(out) for out, src in f.columns.items()]
    if f.scale == "minmax":
        a = f.scale_args
        cols.append(minmax_scale(col(a["value"]), col(a["low"]), col(a["high"]))
                    .alias("value_percentile"))
    elif f.scale == "affine":
        a = f.scale_args
        cols.append(affine_with_overrides(col(a["value"]), col(a["text"]), a.get("center", 90.0),
                                          a.get("scale", 10.0),
                                          a.get("overrides", DISPLAY_OVERRIDE)).alias("value_percentile"))
    cols += [(F.col(f.concept) if f.concept in df.columns else F.lit(None)).cast("long").alias(CODE), F.lit(f.facet).alias("facet")]
    return df.select(*cols)


def _view(es, dictionary, facets, person_id, **kw) -> DataFrame:
    shown = [f for f in facets if f.table in es]
    rows = lookup_join(union_by_name([_facet_rows(es, f, person_id, **kw) for f in shown]), dictionary, CODE).drop(CODE)
    named = [f.facet for f in shown if f.y_from_concept_name]
    if named:
        y = F.col("Y") if "Y" in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn("Y", F.when(F.col("facet").isin(named), F.col("concept_name")).otherwise(y))
    return fill_missing(rows, "concept_name", "NA")


def patient_timeline(es: EntitySet, dictionary: DataFrame, person_id=None,
                     facets=TIMELINE_FACETS, time_range=None) -> DataFrame:
    """Conditions, drugs and visits as one timeline.

    ``time_range=(lo, hi)`` keeps rows whose span overlaps the range (the
    reference's plot range hides marks; by default no row is dropped).
    """
    return _view(es, dictionary, facets, person_id, time_range=time_range,
                 start_col="start_datetime", end_col="end_datetime")


def patient_measurements(es: EntitySet, dictionary: DataFrame, person_id=None,
                         facets=MEASUREMENT_FACETS) -> DataFrame:
    """Measurements (min-max scaled) and observations (affine, text overrides)."""
    return _view(es, dictionary, facets, person_id)
