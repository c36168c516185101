"""Bucketed table sets, stored encoders, mergeable sketches."""

import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators.sketches import daily_sketches, error_bound, estimates, merge_sketches
from cohortlens.plans.features import ChildConfig, FeatureConfig, feature_matrix, plan_features
from cohortlens.sources import Encoding, fit_encoding, load_bucketed, load_encoding, save_bucketed, save_encoding
from tests.test_planner import CUT, ROWS, config, day, table_set


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_matrix_of_a_bucketed_set_needs_no_exchange(spark, tmp_path):
    es = table_set(spark, ROWS)
    save_bucketed(es, str(tmp_path / "b"), 4)
    back = load_bucketed(spark, str(tmp_path / "b"))
    assert back.relationships == es.relationships and set(back.tables) == set(es.tables)
    cfg = config(ChildConfig("e", ("count", "mean", "last"), ("v",), (), "code", ("count", "max")))
    want, got = feature_matrix(es, cfg, CUT).matrix, feature_matrix(back, cfg, CUT).matrix
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in final_plan(feature_matrix(back, cfg, CUT).matrix)
        assert "Exchange" in final_plan(feature_matrix(es, cfg, CUT).matrix)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(list((tmp_path / "b" / "e").glob("part-*"))) <= 4


def test_bucketed_set_loads_in_another_session(spark, tmp_path):
    es = table_set(spark, ROWS)
    save_bucketed(es, str(tmp_path / "b"), 3)
    assert load_bucketed(spark.newSession(), str(tmp_path / "b"))["e"].count() == len(ROWS)
    with pytest.raises(Exception, match="(?i)exist"):
        save_bucketed(es, str(tmp_path / "b"), 3)


def test_encoding_gives_the_same_columns_on_a_changed_table(spark, tmp_path):
    train = spark.createDataFrame([(i, "abc"[i % 3] if i % 4 else None, decimal.Decimal(i % 2) / 4, dt.date(2020, 1, 1 + i % 2), i % 2 == 0, float(i), i % 5) for i in range(20)],
                                  "k long, s string, d decimal(5,2), t date, b boolean, x double, n long")
    enc = fit_encoding(train, ["s", "d", "t", "b", "n"], ["x"], top_n=2)
    save_encoding(spark, enc, str(tmp_path / "e"))
    back = load_encoding(spark, str(tmp_path / "e"))
    assert back == enc
    other = spark.createDataFrame([(1, "zz", decimal.Decimal("0.25"), dt.date(2020, 1, 2), None, 38.0, 99), (2, None, None, None, True, None, None)], train.schema)
    a, b = back.apply(train), back.apply(other)
    assert a.columns == b.columns
    row = {r.k: r.asDict() for r in b.collect()}
    assert row[1]["s__is_unknown"] and row[1]["d__is_0_x2E_25"] and not row[1]["d__is_unknown"] and row[1]["x__scaled"] == 2.0 and row[1]["b__is_unknown"]
    assert row[2]["x__scaled"] is None and row[2]["b__is_True"] and row[2]["t__is_unknown"]
    with pytest.raises(ValueError):
        back.apply(other.drop("s"))
    empty = fit_encoding(train.limit(0), ["s"], ["x"])
    assert empty.apply(other).select("s__is_unknown", "x__scaled").first() == (True, None)


def test_encoding_belongs_to_its_definitions(spark, tmp_path):
    es = table_set(spark, ROWS)
    defs = plan_features(es, config(ChildConfig("e", ("last", "mean"), ("v",), ("code",))))
    m = feature_matrix(es, config(ChildConfig("e", ("last", "mean"), ("v",), ("code",))), CUT, defs=defs).matrix
    enc = fit_encoding(m, ["e__last__code"], ["e__mean__v"], defs=defs)
    save_encoding(spark, enc, str(tmp_path / "e"))
    back = load_encoding(spark, str(tmp_path / "e"))
    assert set(back.apply(m, defs).columns) >= {"e__last__code__is_5", "e__last__code__is__x2D_5", "e__mean__v__scaled"}
    with pytest.raises(ValueError, match="other feature definitions"):
        back.apply(m, defs[:1])
    assert Encoding().apply(m).columns == m.columns


def test_daily_sketches_merge_to_the_whole(spark):
    rng = random.Random(4)
    rows = [(1 if i % 3 else 2, day(i // 3 % 9), rng.randrange(6000) if i % 50 else None) for i in range(30_000)] + [(3, day(1), None)]
    df = spark.createDataFrame(rows, "pid long, at timestamp_ntz, x long")
    kept = daily_sketches(df, "pid", "at", "x")
    assert kept.count() == 18
    merged = estimates(merge_sketches(kept, "pid"))
    exact = df.groupBy("pid").agg(F.count_distinct("x").alias("n"))
    got = merged.join(exact, "pid").withColumn("ok", F.abs(F.col("num_unique") - F.col("n")) <= error_bound(F.col("n"))).collect()
    assert len(got) == 2 and all(r.ok and r.n > 4000 for r in got)
    two_days = estimates(merge_sketches(kept.where("day < '2024-01-03'"), "pid")).collect()
    assert all(r.num_unique < 6000 for r in two_days)


def test_approximate_primitive(spark):
    es = table_set(spark, ROWS)
    m = feature_matrix(es, config(ChildConfig("e", ("num_unique", "num_unique_approx"), ("v",), ("code",))), CUT).matrix
    for r in m.collect():
        assert r["e__num_unique__v"] == r["e__num_unique_approx__v"] and r["e__num_unique__code"] == r["e__num_unique_approx__code"]
    assert FeatureConfig().target == "person"
