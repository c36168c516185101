"""Hand-made health tables covering the cases listed in FIXTURES.md."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession, functions as F

from cohortlens import schemas as S
from cohortlens.sources.entityset import EntitySet, _observation_recode, RECODED


def t(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


CUTOFF = "2020-06-01 00:00:00"

PERSON = [
    # person_id, birth, gender, race, ethnicity, location, gender_source
    (1, t("1950-06-02 12:00:00"), 8507, 1, 10, 100, "M"),
    (2, t("1980-01-01 00:00:00"), 8532, 2, 10, 100, "F"),
    (3, t("2000-12-31 00:00:00"), 8532, 1, 11, 101, "F"),
    (4, None, None, None, None, None, None),   # person without children
]
PERSON_SCHEMA = ("person_id long, birth_datetime timestamp_ntz, gender_concept_id long, "
                 "race_concept_id long, ethnicity_concept_id long, location_id long, "
                 "gender_source_value string")

GOLD = [(1, 1), (2, 0), (9, 1)]   # 9: label without person; 3, 4: persons without label

MEASUREMENT = [
    # id, person, time, value, low, high, concept
    (10, 1, t("2020-01-01 08:00:00"), 1.0, 0.0, 10.0, 100),
    (11, 1, t("2020-01-02 08:00:00"), 2.0, 0.0, 10.0, 100),
    (12, 1, t("2020-01-03 08:00:00"), 4.0, 0.0, 10.0, 100),
    (13, 1, t("2020-01-03 08:00:00"), None, 5.0, 5.0, 200),    # tie in time; last value null; zero range
    (14, 2, t("2020-02-01 00:00:00"), 7.0, None, None, 100),   # null range
    (15, 2, t("2020-02-02 00:00:00"), 7.0, 1.0, 9.0, 100),
    (16, 2, t("2020-02-03 00:00:00"), 7.0, 1.0, 9.0, 100),     # three equal values
    (17, 3, t("2020-03-01 00:00:00"), 5.0, 0.0, 10.0, 300),    # single value
    (18, 1, t("2021-01-01 00:00:00"), 99.0, 0.0, 10.0, 100),   # after the cutoff
]
MEASUREMENT_SCHEMA = ("measurement_id long, person_id long, measurement_datetime timestamp_ntz, "
                      "value_as_number double, range_low double, range_high double, "
                      "measurement_concept_id long")

OBSERVATION = [
    # id, person, concept, time, value_number, value_string
    (20, 1, 500, t("2020-01-05 00:00:00"), None, "Yes"),
    (21, 1, 500, t("2020-01-06 00:00:00"), 95.0, None),
    (22, 2, 600, t("2020-01-07 00:00:00"), 93.0, "No"),
    (23, 2, 600, t("2020-01-08 00:00:00"), None, "Never"),
    (24, 3, None, t("2020-01-09 00:00:00"), 88.0, "maybe"),   # other text, null code
]
OBSERVATION_SCHEMA = ("observation_id long, person_id long, observation_concept_id long, "
                      "observation_datetime timestamp_ntz, value_as_number double, value_as_string string")

DEVICE = [
    (30, 1, t("2020-01-01 00:00:00"), t("2020-01-02 00:00:00")),
    (31, 1, t("2020-01-03 00:00:00"), t("2020-07-01 00:00:00")),   # end after the cutoff
    (32, 1, t("2020-01-07 00:00:00"), None),
    (33, 2, t("2020-03-01 00:00:00"), t("2020-03-02 00:00:00")),   # one exposure
]
DEVICE_SCHEMA = ("device_exposure_id long, person_id long, device_exposure_start_datetime timestamp_ntz, "
                 "device_exposure_end_datetime timestamp_ntz")

CONDITION = [
    (40, 1, t("2020-01-01 00:00:00"), t("2020-01-10 00:00:00"), 1000, "active"),
    (41, 2, t("2020-02-01 00:00:00"), None, 9999, None),          # code missing from dictionary
    (42, 7, t("2020-02-01 00:00:00"), None, 1000, None),          # orphan: person 7 missing
    (42, 2, t("2020-02-05 00:00:00"), None, None, "resolved"),    # duplicate key 42, null code
]
CONDITION_SCHEMA = ("condition_occurrence_id long, person_id long, condition_start_datetime timestamp_ntz, "
                    "condition_end_datetime timestamp_ntz, condition_concept_id long, "
                    "condition_status_source_value string")

DRUG = [
    (50, 1, 2000, t("2020-01-01 00:00:00"), t("2020-01-31 00:00:00"), "done", 1.0, 30.0, 30.0, "oral", "mg"),
    (51, 1, 2000, t("2020-05-01 00:00:00"), t("2020-08-01 00:00:00"), "stopped", 2.0, 60.0, 90.0, "oral",
     "mg"),
]
DRUG_SCHEMA = ("drug_exposure_id long, person_id long, drug_concept_id long, "
               "drug_exposure_start_datetime timestamp_ntz, drug_exposure_end_datetime timestamp_ntz, "
               "stop_reason string, refills double, quantity double, days_supply double, "
               "route_source_value string, dose_unit_source_value string")

VISIT = [
    (1, 3000, t("2020-01-01 00:00:00"), t("2020-01-02 00:00:00")),
    (1, 4242, t("2020-02-01 00:00:00"), t("2020-02-01 06:00:00")),   # unknown code
    (2, 3000, t("2020-03-01 00:00:00"), t("2020-03-03 00:00:00")),
]
VISIT_SCHEMA = ("person_id long, visit_concept_id long, visit_start_datetime timestamp_ntz, "
                "visit_end_datetime timestamp_ntz")

DICTIONARY = [(100, "heart rate"), (200, "spo2"), (300, "temp"), (500, "smoker"), (600, "smoker"),
              (1000, "cough"), (2000, "aspirin"), (3000, "inpatient"), (3000, "inpatient visit")]


def health_set(spark: SparkSession) -> tuple[EntitySet, object]:
    unit = F.lit("u")
    obs = spark.createDataFrame(OBSERVATION, OBSERVATION_SCHEMA)
    tables = {
        "person": spark.createDataFrame(PERSON, PERSON_SCHEMA),
        "goldstandard": spark.createDataFrame(GOLD, "person_id long, status long"),
        "measurement": spark.createDataFrame(MEASUREMENT, MEASUREMENT_SCHEMA)
        .withColumn("unit_source_value", unit),
        "observation": _observation_recode(obs, wide=True).withColumn("unit_source_value", unit),
        "device_exposure": spark.createDataFrame(DEVICE, DEVICE_SCHEMA),
        "condition_occurrence": spark.createDataFrame(CONDITION, CONDITION_SCHEMA),
        "drug_exposure": spark.createDataFrame(DRUG, DRUG_SCHEMA),
        "visit_occurrence": spark.createDataFrame(VISIT, VISIT_SCHEMA),
    }
    specs = {n: S.TABLES[n] for n in tables}
    o = S.TABLES["observation"]
    specs["observation"] = S.TableSpec(o.name, o.columns + (S.Col(RECODED, S.NUMERIC),), o.key,
                                       o.time_index, o.secondary, o.person_key)
    rels = tuple(r for r in S.RELATIONSHIPS if r.child in tables)
    dictionary = spark.createDataFrame(DICTIONARY, "concept_id long, concept_name string")
    return EntitySet("fixture", tables, specs, rels), dictionary
