from cohortlens.streaming import read_streamed, stream_table


def test_stream_ingest_replay_safe(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_text(
        "observation_id,person_id,observation_concept_id,observation_datetime,observation_type_concept_id,"
        "value_as_number,value_as_string,value_as_concept_id,unit_concept_id,observation_source_concept_id,"
        "unit_source_value\n"
        "1,1,500,2020-01-01,,,Yes,,,,\n2,1,500,2020-01-02,,93.5,,,,,\n2,1,500,2020-01-03,,1,No,,,,\n")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stream_table(spark, "observation", str(landing), out, checkpoint=ck)
    rows = sorted((r.observation_id, r.value_recoded) for r in read_streamed(spark, out, "observation").collect())
    assert rows == [(1, 100.0), (2, 0.0), (2, 93.5)]
    checks = spark.read.parquet(out + "/_checks/observation").collect()
    assert [c.duplicate_keys for c in checks] == [1]
    # a second file arrives; the first is not read again
    (landing / "b.csv").write_text(
        "observation_id,person_id,observation_concept_id,observation_datetime,observation_type_concept_id,"
        "value_as_number,value_as_string,value_as_concept_id,unit_concept_id,observation_source_concept_id,"
        "unit_source_value\n3,2,600,2020-02-01,,97,,,,,\n")
    stream_table(spark, "observation", str(landing), out, checkpoint=ck)
    assert read_streamed(spark, out, "observation").count() == 4


def test_stream_generated_keys_unique(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    header = "person_id,visit_concept_id,visit_start_datetime,visit_end_datetime,visit_source_concept_id\n"
    (landing / "a.csv").write_text(header + "1,3000,2020-01-01,2020-01-02,\n2,3000,2020-01-03,2020-01-04,\n")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stream_table(spark, "visit_occurrence", str(landing), out, checkpoint=ck)
    (landing / "b.csv").write_text(header + "3,3000,2020-01-05,2020-01-06,\n")
    stream_table(spark, "visit_occurrence", str(landing), out, checkpoint=ck)
    keys = [r.visit_occurrence_id for r in read_streamed(spark, out, "visit_occurrence").collect()]
    assert len(keys) == 3 and len(set(keys)) == 3


def test_restart_without_a_named_checkpoint_adds_nothing(spark, tmp_path):
    """The state lies beside the output, so a new query on the same folders goes on where the last one stopped."""
    landing = tmp_path / "landing"
    landing.mkdir()
    header = "person_id,visit_concept_id,visit_start_datetime,visit_end_datetime,visit_source_concept_id\n"
    (landing / "a.csv").write_text(header + "1,3000,2020-01-01,2020-01-02,\n2,3000,2020-01-03,2020-01-04,\n")
    out = str(tmp_path / "out")
    for _ in range(2):
        stream_table(spark, "visit_occurrence", str(landing), out)
    (landing / "b.csv").write_text(header + "3,3000,2020-01-05,2020-01-06,\n")
    stream_table(spark, "visit_occurrence", str(landing), out)
    assert sorted(r.person_id for r in read_streamed(spark, out, "visit_occurrence").collect()) == [1, 2, 3]
