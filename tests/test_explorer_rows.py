"""Explorer views on random tables, row by row.

Each source row says on its own which view rows it gives: one for every name of its code (or one
named ``NA``), with the facet's columns and a scaled value worked out from that row alone.
"""

import datetime as dt
import random

import pytest

from cohortlens import schemas as S
from cohortlens.plans.explorer import patient_measurements, patient_timeline
from cohortlens.sources.entityset import EntitySet

NAMES = {1: ["a"], 2: ["b"], 3: ["c", "c2"], 4: ["d"], 5: ["e"]}  # code 3 is listed twice, 6 and up are unknown
DAY0 = dt.datetime(2019, 1, 1)


def names_of(code):
    return NAMES.get(code) or [None]


def at(rng):
    return DAY0 + dt.timedelta(minutes=rng.randrange(600_000))


def maybe(rng, *values):
    return rng.choice([*values, None])


def rows_of(table, rng, n=300):
    """Random rows with the table's columns as a list of dicts."""
    out = []
    for i in range(n):
        row = {"person_id": rng.randrange(1, 20)}
        code = maybe(rng, *range(1, 9))
        start = at(rng)
        if table == "measurement":
            low = maybe(rng, 0.0, 10.0, 40.0)
            row |= {"measurement_id": i, "measurement_datetime": start, "measurement_concept_id": code, "value_as_number": maybe(rng, 1.5, 20.0, 77.25),
                    "range_low": low, "range_high": maybe(rng, low, 40.0, 100.0), "unit_source_value": maybe(rng, "mg")}
        elif table == "observation":
            row |= {"observation_id": i, "observation_datetime": start, "observation_concept_id": code, "value_as_number": maybe(rng, 80.0, 90.0, 97.5),
                    "value_as_string": maybe(rng, "Yes", "No", "Never", "maybe"), "unit_source_value": maybe(rng, "x")}
        elif table == "condition_occurrence":
            row |= {"condition_occurrence_id": i, "condition_start_datetime": start, "condition_end_datetime": maybe(rng, start + dt.timedelta(days=3)),
                    "condition_concept_id": code, "condition_status_source_value": maybe(rng, "active", "resolved")}
        elif table == "drug_exposure":
            row |= {"drug_exposure_id": i, "drug_concept_id": code, "drug_exposure_start_datetime": start, "drug_exposure_end_datetime": start,
                    "refills": maybe(rng, 0.0, 2.0), "quantity": maybe(rng, 30.0), "days_supply": maybe(rng, 7.0), "stop_reason": maybe(rng, "done"),
                    "route_source_value": maybe(rng, "oral", "iv"), "dose_unit_source_value": maybe(rng, "mg")}
        else:
            row |= {"visit_concept_id": code, "visit_start_datetime": start, "visit_end_datetime": maybe(rng, start)}
        out.append(row)
    return out


def loaded(spark, tables):
    frames = {}
    for name, rows in tables.items():
        types = {f.name: f.dataType.simpleString() for f in S.TABLES[name].schema(wide=True).fields}
        columns = list(rows[0])
        frames[name] = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} {types[c]}" for c in columns))
    return EntitySet("random", frames, {n: S.TABLES[n] for n in frames})


def dictionary(spark):
    return spark.createDataFrame([(k, n) for k, ns in NAMES.items() for n in ns], "concept_id long, concept_name string")


def found(df, columns):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in df.collect()), key=repr)


def scaled(row):
    if "range_low" in row:
        v, low, high = row["value_as_number"], row["range_low"], row["range_high"]
        return None if None in (v, low, high) or low == high else round((v - low) / (high - low), 9)
    fixed = {"Yes": 1.0, "No": 0.0, "Never": 0.0}.get(row["value_as_string"])
    return fixed if fixed is not None else None if row["value_as_number"] is None else round((row["value_as_number"] - 90.0) / 10.0, 9)


@pytest.mark.parametrize("seed", [1, 2])
def test_measurement_rows(spark, seed):
    rng = random.Random(seed)
    tables = {t: rows_of(t, rng) for t in ("measurement", "observation")}
    want = [(r["person_id"], t, r[f"{t}_datetime"], name or "NA", scaled(r), r["value_as_number"], r.get("value_as_string"), r.get("range_low"), r.get("range_high"))
            for t, rows in tables.items() for r in rows for name in names_of(r[f"{t}_concept_id"])]
    columns = ["person_id", "facet", "datetime", "concept_name", "value_percentile", "value_as_number", "value_as_string", "range_low", "range_high"]
    assert found(patient_measurements(loaded(spark, tables), dictionary(spark)), columns) == sorted(want, key=repr)


@pytest.mark.parametrize("person", [None, 7])
def test_timeline_rows(spark, person):
    rng = random.Random(3)
    tables = {t: rows_of(t, rng) for t in ("condition_occurrence", "drug_exposure", "visit_occurrence")}
    prefix = {"condition_occurrence": "condition", "drug_exposure": "drug_exposure", "visit_occurrence": "visit"}
    code = {"condition_occurrence": "condition_concept_id", "drug_exposure": "drug_concept_id", "visit_occurrence": "visit_concept_id"}
    shown = {"condition_occurrence": "condition_status_source_value", "drug_exposure": "route_source_value"}
    want = []
    for t, rows in tables.items():
        for r in rows:
            for name in names_of(r[code[t]]) if person in (None, r["person_id"]) else ():
                y = r[shown[t]] if t in shown else name
                want.append((r["person_id"], t, r[f"{prefix[t]}_start_datetime"], r[f"{prefix[t]}_end_datetime"], y, name or "NA",
                             *(r.get(c) for c in ("refills", "quantity", "days_supply", "stop_reason", "dose_unit_source_value"))))
    columns = ["person_id", "facet", "start_datetime", "end_datetime", "Y", "concept_name", "refills", "quantity", "days_supply", "stop_reason", "dose_unit_source_value"]
    assert found(patient_timeline(loaded(spark, tables), dictionary(spark), person), columns) == sorted(want, key=repr)
