"""The reference's whole flow on the health-table layout, from CSV files:
load -> check -> save -> load -> feature matrix (+ one-hot, label) -> CSV sink,
and the explorer views on the reloaded set."""

import csv
import math

from cohortlens import schemas as S
from cohortlens.plans.explorer import patient_measurements, patient_timeline
from cohortlens.plans.features import REFERENCE_CONFIG, feature_matrix
from cohortlens.sources import load_csv, load_dictionary, load_parquet, read_csv_typed, save, write_matrix
from tests import fixtures as FX


def _write(path, name, header, rows):
    with open(path / f"{name}.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        for r in rows:
            w.writerow(["" if v is None else (v.isoformat(sep=" ") if hasattr(v, "isoformat") else v)
                        for v in r])


def _cols(schema: str):
    return [part.strip().split(" ")[0] for part in schema.split(",")]


def build_csv(path):
    _write(path, "person", _cols(FX.PERSON_SCHEMA), FX.PERSON)
    _write(path, "goldstandard", ["person_id", "status"], FX.GOLD)
    _write(path, "measurement", _cols(FX.MEASUREMENT_SCHEMA), FX.MEASUREMENT)
    _write(path, "observation", _cols(FX.OBSERVATION_SCHEMA), FX.OBSERVATION)
    _write(path, "device_exposure", _cols(FX.DEVICE_SCHEMA), FX.DEVICE)
    _write(path, "condition_occurrence", _cols(FX.CONDITION_SCHEMA), FX.CONDITION)
    _write(path, "drug_exposure", _cols(FX.DRUG_SCHEMA), FX.DRUG)
    _write(path, "visit_occurrence", _cols(FX.VISIT_SCHEMA), FX.VISIT)
    _write(path, "procedure_occurrence", ["procedure_occurrence_id", "person_id", "procedure_datetime",
                                          "procedure_concept_id"], [(60, 1, FX.t("2020-01-01 00:00:00"), 7)])
    _write(path, "observation_period", ["observation_period_id", "person_id", "observation_period_start_date",
                                        "observation_period_end_date"],
           [(70, 1, FX.t("2019-01-01 00:00:00"), FX.t("2020-12-31 00:00:00"))])
    _write(path, "data_dictionary", ["concept_id", "concept_name"], FX.DICTIONARY)


def test_reference_flow(spark, tmp_path):
    src = tmp_path / "csv"
    src.mkdir()
    build_csv(src)
    es = load_csv(spark, str(src), dense_keys=True, drop_empty=True)
    assert set(es.tables) == set(S.TABLES)
    report = es.check()
    assert report["condition_occurrence"] == {"duplicate_keys": 1, "orphan_links": 1}
    assert report["measurement"]["orphan_links"] == 0
    # all-null wide-only columns were dropped at load; keys stay
    assert "race_source_concept_id" not in es["person"].columns
    save(es, str(tmp_path / "set"))
    back = load_parquet(spark, str(tmp_path / "set"))
    assert len(back.relationships) == 8

    res = feature_matrix(back, REFERENCE_CONFIG, FX.CUTOFF, encode=True, top_n=10)
    rows = {r.person_id: r.asDict() for r in res.matrix.collect()}
    assert sorted(rows) == [1, 2, 9]
    assert math.isclose(rows[1]["measurement__mean__value_as_number"], 7 / 3)
    assert rows[1]["device_exposure__count"] == 3
    assert rows[1]["gender_concept_id__is_8507"] is True
    # encoding runs before the label join (as in the reference): a label
    # without a person has null encoded columns
    assert rows[9]["gender_concept_id__is_unknown"] is None
    out = str(tmp_path / "matrix")
    write_matrix(res.matrix, out, fmt="csv")
    again = read_csv_typed(spark, out, res.matrix.schema)
    assert again.count() == 3

    d = load_dictionary(spark, str(src / "data_dictionary.csv"))
    tl = patient_timeline(back, d, 1).collect()
    assert len(tl) == 6
    ms = patient_measurements(back, d, 1).collect()
    assert {r.facet for r in ms} == {"measurement", "observation"}


def test_gen_feature_matrix_entry_point(spark, tmp_path):
    """The reference's entry-point shape: definitions only, computed, and from a
    saved definitions file (with encoding, which the reference breaks on)."""
    from cohortlens import gen_feature_matrix
    from cohortlens.sources import save_defs

    src = tmp_path / "csv"
    src.mkdir()
    build_csv(src)
    es = load_csv(spark, str(src))
    defs = gen_feature_matrix(es, FX.CUTOFF, features_only=True)
    assert any(d.where_value is not None for d in defs)
    matrix, defs2 = gen_feature_matrix(es, FX.CUTOFF)
    assert [d.name for d in defs2] == [d.name for d in defs]
    rows = {r.person_id: r.asDict() for r in matrix.collect()}
    assert sorted(rows) == [1, 2, 9]                       # labelled persons (right join)
    assert rows[1]["device_exposure__count"] == 3
    path = str(tmp_path / "defs")
    save_defs(spark, defs, path, REFERENCE_CONFIG)
    enc, loaded = gen_feature_matrix(es, FX.CUTOFF, feature_matrix_encode=True, saved_features=path)
    assert [d.name for d in loaded] == [d.name for d in defs]
    enc_rows = {r.person_id: r.asDict() for r in enc.collect()}
    assert enc_rows[1]["gender_concept_id__is_8507"] is True
    assert math.isclose(enc_rows[1]["measurement__mean__value_as_number"],
                        rows[1]["measurement__mean__value_as_number"])
