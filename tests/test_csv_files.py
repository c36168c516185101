"""CSV files as they come: headers of their own, quotes, missing values, bad rows, repeated keys."""

import datetime as dt

import pytest

from cohortlens import schemas as S
from cohortlens.sources import csv_rejects, load_csv, load_parquet, read_csv_typed, reject_counts, save
from cohortlens.sources.csv import MISSING
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("v", T.DoubleType()),
                       T.StructField("at", T.TimestampNTZType())])


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns_are_found_by_name_in_every_file(spark, tmp_path):
    path = put(tmp_path / "t", a="id,name,v\n1,one,1.5\n2,two,2\n", b="name,id,v,other\nthree,3,3,x\n", c="v,id\n4,4\n", d="id,name,v\n", e="")
    assert rows(read_csv_typed(spark, path, SCHEMA)) == [(1, "one", 1.5, None), (2, "two", 2.0, None), (3, "three", 3.0, None), (4, None, 4.0, None)]
    kept = read_csv_typed(spark, path, SCHEMA, ["id"], extra_columns=True)
    assert kept.columns == ["id", "other"] and rows(kept) == [(1, None), (2, None), (3, "x"), (4, None)]


def test_quotes_and_line_breaks(spark, tmp_path):
    path = put(tmp_path / "t", a='id,name,v\n5,"Tablet ""XR"", 5 mg",1\n6,"a\\",2\n7, b ,3\n')
    assert rows(read_csv_typed(spark, path, SCHEMA, ["id", "name", "v"])) == [(5, 'Tablet "XR", 5 mg', 1.0), (6, "a\\", 2.0), (7, " b ", 3.0)]
    path = put(tmp_path / "u", a='id,name,v\n5,"two\nlines, ""q""",1\n6,x,2\n', b='v,name,id\n3,"\n",7\n')
    assert rows(read_csv_typed(spark, path, SCHEMA, ["id", "name", "v"], quoted_breaks=True)) == [(5, 'two\nlines, "q"', 1.0), (6, "x", 2.0), (7, "\n", 3.0)]


def test_missing_values_and_codes_as_floats(spark, tmp_path):
    body = "".join(f"{i},{m},{m},{m}\n" for i, m in enumerate(MISSING))
    path = put(tmp_path / "t", a="id,name,v,at\n" + body + "8507.0,NaNa,1e3,20200102\n1e3,x,inf,1/2/2020 3:04\n8.5,,,\n99999999999999999999,,,\n")
    df = read_csv_typed(spark, path, SCHEMA)
    assert df.where(F.col("id") < len(MISSING)).where("name IS NULL AND v IS NULL AND at IS NULL").count() == len(MISSING)
    got = {r.id: r for r in df.where("name IS NOT NULL").collect()}
    assert got[8507].name == "NaNa" and got[8507].v == 1000.0 and got[8507].at == dt.datetime(2020, 1, 2)
    assert got[1000].at == dt.datetime(2020, 1, 2, 3, 4) and got[1000].v == float("inf")
    assert df.where("id IS NULL").count() == 2 and df.where("isnan(v)").count() == 0
    assert reject_counts(spark, path, SCHEMA) == {"id": 2, "v": 0, "at": 0}


def test_rejected_rows_are_listed_with_file_and_cells(spark, tmp_path):
    path = put(tmp_path / "t", a="id,name,v\n1,a,x\n2,b,2\n3,c\n4,d,4,5\n", b="v,id\n1,one\n")
    bad = csv_rejects(spark, path, SCHEMA, ["id", "name", "v"])
    got = sorted((r.file.rsplit("/", 1)[1], r.failed, r.line) for r in bad.collect())
    assert got == [("a.csv", ["(cells)"], "3,c"), ("a.csv", ["(cells)"], "4,d,4,5"), ("a.csv", ["v"], None), ("b.csv", ["id"], None)]
    assert bad.where("array_contains(failed, 'id')").first().cells["id"] == "one"
    assert rows(read_csv_typed(spark, path, SCHEMA, ["id", "v"], drop_rejects=True)) == [(2, 2.0)]


def test_settings_stay_and_block_size_holds(spark, tmp_path):
    path = put(tmp_path / "t", a="id,v\n" + "".join(f"{i},{i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = read_csv_typed(spark, path, SCHEMA, ["id", "v"], block_bytes=16_384)
    assert df.rdd.getNumPartitions() > 5 and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    other = spark.range(20_000).withColumnRenamed("id", "k")
    assert df.join(other, F.col("id") == F.col("k")).agg(F.sum("v")).first()[0] == sum(range(20_000))


MEASUREMENT = "measurement_id,person_id,measurement_datetime,value_as_number,measurement_concept_id\n"


@pytest.fixture
def extract(tmp_path):
    folder = tmp_path / "in"
    put(folder, person="person_id,birth_datetime,gender_concept_id\n1,1950-06-02,8507\n2,1980-01-31,8532.0\n",
        goldstandard="site,person_id,onset_day,status\nnorth,1,3,1\nsouth,2,NA,0\n",
        measurement=MEASUREMENT + "1,1,2020-01-01,5,100\n2,1,2020-01-02,NaN,100\n3,2,2020-01-03,bad,200\n4,2,2020-01-04,7,200\n4,2,2020-01-05,8,200\n,2,2020-01-06,9,200\n")
    return str(folder)


TABLES = ("person", "goldstandard", "measurement")


def test_label_columns_are_kept_through_save_and_load(spark, extract, tmp_path):
    es = load_csv(spark, extract, tables=TABLES)
    save(es, str(tmp_path / "set"))
    for s in (es, load_parquet(spark, str(tmp_path / "set"))):
        assert sorted(s["goldstandard"].select("person_id", "status", "site", "onset_day").collect()) == [(1, 1, "north", "3"), (2, 0, "south", None)]
    assert es["person"].where("person_id = 2").first().gender_concept_id == 8532


def test_quarantine_takes_bad_cells_and_repeated_keys(spark, extract, tmp_path):
    q = str(tmp_path / "q")
    es = load_csv(spark, extract, tables=TABLES, quarantine=q, repeated_keys="quarantine")
    assert sorted(r.measurement_id for r in es["measurement"].collect()) == [1, 2]
    assert [r.failed for r in spark.read.parquet(f"{q}/measurement/cells").collect()] == [["value_as_number"]]
    assert sorted((r.measurement_id, r.value_as_number) for r in spark.read.parquet(f"{q}/measurement/keys").collect() if r.measurement_id) == [(4, 7.0), (4, 8.0)]
    assert spark.read.parquet(f"{q}/measurement/keys").where("measurement_id IS NULL").count() == 1
    assert spark.read.parquet(f"{q}/person/keys").count() == 0


def test_repeated_keys_raise_on_request(spark, extract):
    with pytest.raises(ValueError, match="measurement_id"):
        load_csv(spark, extract, tables=TABLES, repeated_keys="raise")
    assert load_csv(spark, extract, tables=("person",), repeated_keys="raise")["person"].count() == 2
    for bad in ({"repeated_keys": "quarantine"}, {"repeated_keys": "drop"}):
        with pytest.raises(ValueError):
            load_csv(spark, extract, tables=TABLES, **bad)
    assert load_csv(spark, extract, tables=TABLES)["measurement"].count() == 6


def test_delayed_columns_without_an_end(spark):
    """A null end hides nothing; an end column that the load dropped leaves its columns known with the row."""
    from cohortlens.functions.time import ts_ntz
    from cohortlens.operators.clean import drop_all_null_columns
    from cohortlens.operators.visibility import visible_rows

    spec = S.CONDITION_OCCURRENCE
    end = next(iter(spec.secondary))
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), None, 5), (2, dt.datetime(2020, 1, 1), dt.datetime(2020, 3, 1), 6), (3, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2), 7)],
                               f"k long, at timestamp_ntz, {end} timestamp_ntz, code long")
    seen = visible_rows(df, "at", ts_ntz("2020-02-01"), {end: ("code",)})
    assert rows(seen.select("k", "code")) == [(1, 5), (2, None), (3, 7)]
    assert rows(visible_rows(df.drop(end), "at", ts_ntz("2020-02-01"), {end: ("code",)}).select("k", "code")) == [(1, 5), (2, 6), (3, 7)]
    kept = drop_all_null_columns(df.where("k = 1"), keep=("k", "at", end)).columns
    assert kept == ["k", "at", end, "code"]
