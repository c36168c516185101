"""Fixed schemas and column roles of the patient table set.

Every input table gets a fixed ``StructType`` (no schema inference) and a
small ``TableSpec`` that records its row key, time index, delayed-visibility
("secondary") time columns and the role of each column.  Roles are plain
metadata: they drive the feature planner and the checks, not the storage.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, asdict

from pyspark.sql import types as T

# Column roles.
INDEX = "index"            # row key
ID = "id"                  # foreign key to person
TIME_INDEX = "time_index"  # row becomes known at this time
DATETIME = "datetime"
DATE_OF_BIRTH = "date_of_birth"
CATEGORICAL = "categorical"
NUMERIC = "numeric"
TEXT = "text"

_SPARK_TYPE = {
    INDEX: T.LongType(), ID: T.LongType(), TIME_INDEX: T.TimestampNTZType(),
    DATETIME: T.TimestampNTZType(), DATE_OF_BIRTH: T.TimestampNTZType(),
    NUMERIC: T.DoubleType(), TEXT: T.StringType(),
}


@dataclass(frozen=True)
class Col:
    name: str
    role: str
    dtype: str = ""          # "long" | "string" | "double" | "timestamp_ntz"; "" = from role
    wide_only: bool = False  # kept only by the wide load

    def spark_type(self) -> T.DataType:
        if self.dtype:
            return T._parse_datatype_string(self.dtype)
        if self.role == CATEGORICAL:
            return T.LongType()
        return _SPARK_TYPE[self.role]


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[Col, ...]
    key: str | None = None
    time_index: str | None = None
    # secondary time column -> columns whose values are only known from it
    secondary: dict[str, tuple[str, ...]] = field(default_factory=dict)
    person_key: str = "person_id"
    generated_key: bool = False   # key is not in the input files; create it

    def schema(self, wide: bool = True) -> T.StructType:
        return T.StructType([
            T.StructField(c.name, c.spark_type(), c.name != self.key or self.generated_key)
            for c in self.columns if (wide or not c.wide_only)
            and not (self.generated_key and c.name == self.key)])

    def column_names(self, wide: bool = True) -> list[str]:
        return [c.name for c in self.columns if wide or not c.wide_only]

    def role(self, column: str) -> str:
        for c in self.columns:
            if c.name == column:
                return c.role
        raise KeyError(column)

    def columns_with_role(self, *roles: str) -> list[str]:
        return [c.name for c in self.columns if c.role in roles]

    def to_json(self) -> dict:
        d = asdict(self)
        d["secondary"] = {k: list(v) for k, v in self.secondary.items()}
        return d

    @staticmethod
    def from_json(d: dict) -> "TableSpec":
        return TableSpec(
            name=d["name"], columns=tuple(Col(**c) for c in d["columns"]),
            key=d.get("key"), time_index=d.get("time_index"),
            secondary={k: tuple(v) for k, v in d.get("secondary", {}).items()},
            person_key=d.get("person_key", "person_id"),
            generated_key=d.get("generated_key", False))


def _c(name, role, dtype="", wide_only=False):
    return Col(name, role, dtype, wide_only)


S = "string"

# The health-record table layout (table names, column names,
# roles, keys, time columns) that the loader must accept unchanged.
PERSON = TableSpec("person", (
    _c("person_id", INDEX), _c("birth_datetime", DATE_OF_BIRTH),
    _c("gender_concept_id", CATEGORICAL), _c("race_concept_id", CATEGORICAL),
    _c("ethnicity_concept_id", CATEGORICAL), _c("location_id", CATEGORICAL),
    _c("gender_source_value", CATEGORICAL, S, True),
    _c("race_source_concept_id", CATEGORICAL, "", True),
    _c("ethnicity_source_concept_id", CATEGORICAL, "", True),
), key="person_id")

GOLDSTANDARD = TableSpec("goldstandard", (
    _c("person_id", INDEX), _c("status", CATEGORICAL),
), key="person_id")

CONDITION_OCCURRENCE = TableSpec("condition_occurrence", (
    _c("condition_occurrence_id", INDEX), _c("person_id", ID),
    _c("condition_start_datetime", TIME_INDEX), _c("condition_end_datetime", DATETIME),
    _c("condition_concept_id", CATEGORICAL),
    _c("condition_type_concept_id", CATEGORICAL, "", True),
    _c("condition_source_concept_id", CATEGORICAL, "", True),
    _c("condition_status_source_value", CATEGORICAL, S, True),
    _c("condition_status_concept_id", CATEGORICAL, "", True),
), key="condition_occurrence_id", time_index="condition_start_datetime",
    secondary={"condition_end_datetime": ("condition_end_datetime",)})

DEVICE_EXPOSURE = TableSpec("device_exposure", (
    _c("device_exposure_id", INDEX), _c("person_id", ID),
    _c("device_exposure_start_datetime", TIME_INDEX),
    _c("device_exposure_end_datetime", DATETIME),
), key="device_exposure_id", time_index="device_exposure_start_datetime",
    secondary={"device_exposure_end_datetime": ("device_exposure_end_datetime",)})

DRUG_EXPOSURE = TableSpec("drug_exposure", (
    _c("drug_exposure_id", INDEX), _c("person_id", ID), _c("drug_concept_id", CATEGORICAL),
    _c("drug_exposure_start_datetime", TIME_INDEX), _c("drug_exposure_end_datetime", DATETIME),
    _c("stop_reason", CATEGORICAL, S, True), _c("refills", NUMERIC, "", True),
    _c("quantity", NUMERIC, "", True), _c("days_supply", NUMERIC, "", True),
    _c("drug_type_concept_id", CATEGORICAL, "", True),
    _c("drug_source_concept_id", CATEGORICAL, "", True),
    _c("route_source_value", CATEGORICAL, S, True),
    _c("dose_unit_source_value", CATEGORICAL, S, True),
), key="drug_exposure_id", time_index="drug_exposure_start_datetime",
    secondary={"drug_exposure_end_datetime": (
        "drug_exposure_end_datetime", "refills", "quantity", "days_supply", "stop_reason")})

MEASUREMENT = TableSpec("measurement", (
    _c("measurement_id", INDEX), _c("person_id", ID), _c("measurement_datetime", TIME_INDEX),
    _c("value_as_number", NUMERIC), _c("range_low", NUMERIC, "", True),
    _c("range_high", NUMERIC, "", True), _c("value_source_value", NUMERIC, "", True),
    _c("measurement_concept_id", CATEGORICAL),
    _c("measurement_type_concept_id", CATEGORICAL, "", True),
    _c("operator_concept_id", CATEGORICAL, "", True),
    _c("value_as_concept_id", CATEGORICAL, "", True),
    _c("unit_concept_id", CATEGORICAL, "", True),
    _c("measurement_source_concept_id", CATEGORICAL, "", True),
    _c("unit_source_value", CATEGORICAL, S, True),
), key="measurement_id", time_index="measurement_datetime")

OBSERVATION = TableSpec("observation", (
    _c("observation_id", INDEX), _c("person_id", ID), _c("observation_concept_id", CATEGORICAL),
    _c("observation_datetime", TIME_INDEX),
    _c("observation_type_concept_id", CATEGORICAL, "", True),
    _c("value_as_number", NUMERIC), _c("value_as_string", TEXT),
    _c("value_as_concept_id", CATEGORICAL, "", True),
    _c("unit_concept_id", CATEGORICAL, "", True),
    _c("observation_source_concept_id", CATEGORICAL, "", True),
    _c("unit_source_value", CATEGORICAL, S, True),
), key="observation_id", time_index="observation_datetime")

OBSERVATION_PERIOD = TableSpec("observation_period", (
    _c("observation_period_id", INDEX), _c("person_id", ID),
    _c("observation_period_start_date", TIME_INDEX),
    _c("observation_period_end_date", DATETIME),
), key="observation_period_id", time_index="observation_period_start_date",
    secondary={"observation_period_end_date": ("observation_period_end_date",)})

PROCEDURE_OCCURRENCE = TableSpec("procedure_occurrence", (
    _c("procedure_occurrence_id", INDEX), _c("person_id", ID),
    _c("procedure_datetime", TIME_INDEX), _c("procedure_concept_id", CATEGORICAL),
    _c("procedure_type_concept_id", CATEGORICAL, "", True),
    _c("procedure_source_concept_id", CATEGORICAL, "", True),
), key="procedure_occurrence_id", time_index="procedure_datetime")

VISIT_OCCURRENCE = TableSpec("visit_occurrence", (
    _c("visit_occurrence_id", INDEX), _c("person_id", ID), _c("visit_concept_id", CATEGORICAL),
    _c("visit_start_datetime", TIME_INDEX), _c("visit_end_datetime", DATETIME),
    _c("visit_source_concept_id", CATEGORICAL, "", True),
), key="visit_occurrence_id", time_index="visit_start_datetime",
    secondary={"visit_end_datetime": ("visit_end_datetime",)}, generated_key=True)

DATA_DICTIONARY = TableSpec("data_dictionary", (
    _c("concept_id", CATEGORICAL), _c("concept_name", TEXT),
))

TABLES: dict[str, TableSpec] = {t.name: t for t in (
    CONDITION_OCCURRENCE, DEVICE_EXPOSURE, DRUG_EXPOSURE, GOLDSTANDARD, MEASUREMENT,
    OBSERVATION, OBSERVATION_PERIOD, PERSON, PROCEDURE_OCCURRENCE, VISIT_OCCURRENCE)}

# 1:N edges person.person_id -> child.person_id (the label table has none; it
# is joined explicitly).
CHILD_TABLES = ("condition_occurrence", "device_exposure", "drug_exposure", "measurement",
                "observation", "procedure_occurrence", "observation_period", "visit_occurrence")


@dataclass(frozen=True)
class Relationship:
    parent: str
    parent_key: str
    child: str
    child_key: str


RELATIONSHIPS = tuple(Relationship("person", "person_id", c, "person_id") for c in CHILD_TABLES)


def specs_to_json(specs: dict[str, TableSpec]) -> str:
    return json.dumps({k: v.to_json() for k, v in specs.items()}, indent=1, sort_keys=True)


def specs_from_json(text: str) -> dict[str, TableSpec]:
    return {k: TableSpec.from_json(v) for k, v in json.loads(text).items()}
