import math

import pytest

from cohortlens.plans.explorer import patient_info, patient_measurements, patient_timeline
from tests.fixtures import health_set, t


@pytest.fixture(scope="module")
def es_dict(spark):
    return health_set(spark)


def test_patient_info_one_and_all(es_dict):
    es, _ = es_dict
    one = patient_info(es, 1).collect()
    assert [(r.person_id, r.status, r.gender_source_value) for r in one] == [(1, 1, "M")]
    everyone = {r.person_id: r.status for r in patient_info(es).collect()}
    assert everyone == {1: 1, 2: 0, 3: None, 4: None}   # label joined by key, not row position


def test_timeline_rows_and_names(es_dict):
    es, d = es_dict
    rows = patient_timeline(es, d, 1).collect()
    facets = sorted(r.facet for r in rows)
    # 1 condition, 2 drugs, visit 3000 twice (code twice in the dictionary) + unknown visit
    assert facets == ["condition_occurrence", "drug_exposure", "drug_exposure",
                      "visit_occurrence", "visit_occurrence", "visit_occurrence"]
    unknown = [r for r in rows if r.facet == "visit_occurrence" and r.concept_name == "NA"]
    assert len(unknown) == 1 and unknown[0].Y is None     # Y copied before the 'NA' fill
    drug = [r for r in rows if r.facet == "drug_exposure"]
    assert {r.Y for r in drug} == {"oral"} and {r.concept_name for r in drug} == {"aspirin"}
    cond = [r for r in rows if r.facet == "condition_occurrence"][0]
    assert cond.Y == "active" and cond.refills is None


def test_timeline_missing_and_null_codes(es_dict):
    es, d = es_dict
    rows = patient_timeline(es, d, 2).collect()
    cond = sorted((r.start_datetime, r.concept_name) for r in rows if r.facet == "condition_occurrence")
    assert cond == [(t("2020-02-01 00:00:00"), "NA"), (t("2020-02-05 00:00:00"), "NA")]


def test_timeline_range_filter(es_dict):
    es, d = es_dict
    rows = patient_timeline(es, d, 1, time_range=("2020-01-15", "2020-03-01")).collect()
    assert sorted(r.start_datetime for r in rows) == [t("2020-01-01 00:00:00"), t("2020-02-01 00:00:00")]


def test_measurement_scaling(es_dict):
    es, d = es_dict
    rows = patient_measurements(es, d, None).collect()
    m = {r.value_as_number: r for r in rows if r.facet == "measurement" and r.person_id == 1}
    assert math.isclose(m[4.0].value_percentile, 0.4)
    zero_range = [r for r in rows if r.facet == "measurement" and r.range_low == 5.0]
    assert zero_range[0].value_percentile is None           # hi == lo -> null, no error
    null_range = [r for r in rows if r.facet == "measurement" and r.person_id == 2 and r.range_low is None]
    assert null_range[0].value_percentile is None
    obs = {(r.person_id, r.value_as_string): r.value_percentile for r in rows if r.facet == "observation"}
    assert obs[(1, "Yes")] == 1.0 and obs[(2, "No")] == 0.0 and obs[(2, "Never")] == 0.0
    assert math.isclose(obs[(1, None)], 0.5)                 # (95 - 90) / 10
    assert math.isclose(obs[(3, "maybe")], -0.2)             # other text keeps the number
    assert {r.concept_name for r in rows if r.person_id == 3 and r.facet == "observation"} == {"NA"}


def test_filter_pushed_to_scan(spark, es_dict, tmp_path):
    es, d = es_dict
    es["measurement"].write.parquet(str(tmp_path / "m"))
    es2 = es.with_table("measurement", spark.read.parquet(str(tmp_path / "m")))
    plan = patient_measurements(es2, d, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(person_id), EqualTo(person_id,1)]" in plan
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_a_view_runs_no_job_and_reads_a_stored_dictionary_once(spark, es_dict, tmp_path):
    es, d = es_dict
    d.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    tracker = spark.sparkContext.statusTracker()
    jobs = len(tracker.getJobIdsForGroup(None))
    view = patient_timeline(es, stored)
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert len(tracker.getJobIdsForGroup(None)) == jobs
    assert plan.count("FileScan parquet [concept_id") == 1 and "BroadcastExchange" in plan
