import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.plans.features import (ChildConfig, FeatureConfig, REFERENCE_CONFIG, defs_from_json,
                                       defs_to_json, feature_matrix, plan_features)
from tests.fixtures import CUTOFF, health_set, t

CUT = t(CUTOFF)


def rows_by_person(df, key="person_id"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def es_dict(spark):
    return health_set(spark)


@pytest.fixture(scope="module")
def matrix(es_dict):
    es, _ = es_dict
    return rows_by_person(feature_matrix(es, REFERENCE_CONFIG, CUTOFF, label=False).matrix)


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


def test_plain_aggregates(matrix):
    p1 = matrix[1]
    assert close(p1["measurement__mean__value_as_number"], 7 / 3)
    assert p1["measurement__max__value_as_number"] == 4.0
    assert p1["measurement__min__value_as_number"] == 1.0
    assert close(p1["measurement__std__value_as_number"], math.sqrt(7 / 3))
    assert close(p1["measurement__skew__value_as_number"], pd.Series([1.0, 2.0, 4.0]).skew())
    # tie in time broken by key: row 13 is last and its value is null
    assert p1["measurement__last__value_as_number"] is None
    assert p1["measurement__last__measurement_concept_id"] == 200
    assert close(p1["measurement__time_since_last"], (CUT - t("2020-01-03 08:00:00")).total_seconds())


def test_degenerate_counts(matrix):
    p2, p3, p4 = matrix[2], matrix[3], matrix[4]
    assert p2["measurement__std__value_as_number"] == 0.0
    assert p2["measurement__skew__value_as_number"] == 0.0      # three equal values
    assert p3["measurement__std__value_as_number"] is None      # one value
    assert p3["measurement__skew__value_as_number"] is None
    assert p4["measurement__mean__value_as_number"] is None     # no children
    assert p4["device_exposure__count"] == 0


def test_device_primitives(matrix):
    assert matrix[1]["device_exposure__count"] == 3
    assert close(matrix[1]["device_exposure__avg_time_between"], 3 * 86400.0)
    assert close(matrix[1]["device_exposure__time_since_first"],
                 (CUT - t("2020-01-01 00:00:00")).total_seconds())
    assert matrix[2]["device_exposure__count"] == 1
    assert matrix[2]["device_exposure__avg_time_between"] is None
    assert matrix[3]["device_exposure__count"] == 0


def test_age_and_identity(matrix):
    assert close(matrix[1]["age__birth_datetime"], (CUT - t("1950-06-02 12:00:00")).days / 365)
    assert matrix[4]["age__birth_datetime"] is None
    assert matrix[2]["gender_concept_id"] == 8532


def test_conditional_wide(matrix):
    p1 = matrix[1]
    assert close(p1["measurement__mean__value_as_number__where_100"], 7 / 3)
    assert p1["measurement__mean__value_as_number__where_200"] is None
    assert close(p1["measurement__time_since_last__where_200"],
                 (CUT - t("2020-01-03 08:00:00")).total_seconds())
    # recoded observation text: Yes -> 100, then 95
    assert close(p1["observation__mean__value_recoded__where_500"], 97.5)
    assert p1["observation__last__value_recoded"] == 95.0
    assert matrix[2]["observation__max__value_recoded"] == 0.0   # No / Never -> 0


def test_rows_after_cutoff_change_nothing(spark, es_dict):
    es, _ = es_dict
    late = spark.createDataFrame([(99, 2, t("2020-07-01 00:00:00"), 1000.0, None, None, 100, "u")],
                                 es["measurement"].schema)
    es2 = es.with_table("measurement", es["measurement"].unionByName(late))
    cfg = FeatureConfig("person", (REFERENCE_CONFIG.children[0],), (), None)
    defs = plan_features(es, cfg)
    m1 = feature_matrix(es, cfg, CUTOFF, defs=defs).matrix
    m2 = feature_matrix(es2, cfg, CUTOFF, defs=defs).matrix
    assert sorted(m1.collect()) == sorted(m2.collect())


def test_layouts_agree(es_dict):
    es, _ = es_dict
    cfg = FeatureConfig("person", (REFERENCE_CONFIG.children[0],), (), None)
    defs = plan_features(es, cfg)
    wide = rows_by_person(feature_matrix(es, cfg, CUTOFF, defs=defs, layout="wide").matrix)
    mp = rows_by_person(feature_matrix(es, cfg, CUTOFF, defs=defs, layout="map").matrix)
    long = feature_matrix(es, cfg, CUTOFF, defs=defs, layout="long").long["measurement"].collect()
    for r in long:
        p, c = r["person_id"], r["measurement_concept_id"]
        assert close(wide[p][f"measurement__mean__value_as_number__where_{c}"],
                     r["measurement__mean__value_as_number"])
        entry = mp[p]["measurement__where_measurement_concept_id"][c]
        assert close(entry["measurement__max__value_as_number"], r["measurement__max__value_as_number"])


def test_label_right_join(es_dict):
    es, _ = es_dict
    m = feature_matrix(es, REFERENCE_CONFIG, CUTOFF).matrix
    got = rows_by_person(m)
    assert sorted(got) == [1, 2, 9]                       # exactly the labelled persons
    assert got[9]["measurement__mean__value_as_number"] is None
    assert got[1]["status"] == 1


def test_per_person_cutoff(spark, es_dict):
    es, _ = es_dict
    cfg = FeatureConfig("person", (ChildConfig("measurement", ("count", "mean"), ("value_as_number",)),),
                        (), None)
    cuts = spark.createDataFrame([(1, t("2020-01-02 08:00:00")), (2, t("2021-01-01 00:00:00"))],
                                 "person_id long, cutoff_time timestamp_ntz")
    got = rows_by_person(feature_matrix(es, cfg, cuts).matrix)
    assert sorted(got) == [1, 2]
    assert got[1]["measurement__count"] == 2 and close(got[1]["measurement__mean__value_as_number"], 1.5)
    assert got[2]["measurement__count"] == 3


def test_per_person_cutoff_salted_join_agrees(spark, monkeypatch):
    """Above the broadcast bound the cutoff join is salted; the features are
    the same as with the broadcast join, for a hot person too."""
    from cohortlens.plans import features as FM
    from cohortlens.sources.entityset import from_frames
    from cohortlens import schemas as S
    rng = np.random.default_rng(11)
    n = 2000
    pid = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 30, n))
    base = pd.Timestamp("2024-01-01")
    ev = pd.DataFrame({"event_id": np.arange(n), "user_id": pid,
                       "ts": [base + pd.Timedelta(minutes=int(m)) for m in rng.integers(0, 50000, n)],
                       "value": rng.normal(50, 10, n).round(2)})
    events = spark.createDataFrame(ev).withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(5)
    people = spark.createDataFrame(pd.DataFrame({"pid": np.arange(30)}))
    spec = S.TableSpec("events", (S.Col("event_id", S.INDEX), S.Col("user_id", S.ID),
                                  S.Col("ts", S.TIME_INDEX), S.Col("value", S.NUMERIC)),
                       key="event_id", time_index="ts", person_key="user_id")
    pspec = S.TableSpec("people", (S.Col("pid", S.INDEX),), key="pid", person_key="pid")
    es = from_frames("t", {"people": people, "events": events}, {"people": pspec, "events": spec},
                     "people", "pid")
    cfg = FeatureConfig("people", (ChildConfig("events", ("count", "mean", "last", "time_since_last"),
                                               ("value",)),), (), None)
    cuts = spark.createDataFrame(pd.DataFrame({"person_id": np.arange(0, 30, 2),
                                               "cutoff_time": [base + pd.Timedelta(days=int(d))
                                                               for d in rng.integers(5, 30, 15)]})) \
        .withColumn("cutoff_time", F.col("cutoff_time").cast("timestamp_ntz"))
    small = sorted(map(tuple, feature_matrix(es, cfg, cuts).matrix.collect()))
    monkeypatch.setattr(FM, "cutoff_is_small", lambda df: False)
    salted_df = feature_matrix(es, cfg, cuts).matrix
    salted = sorted(map(tuple, salted_df.collect()))
    assert len(small) == 15 and len(salted) == 15
    for a, b in zip(small, salted):
        assert a[0] == b[0] and a[1] == b[1] and a[3] == b[3]
        assert close(a[2], b[2]) and close(a[4], b[4])
    hot = [r for r in small if r[0] == 0][0]
    assert hot[1] > 100                                   # the hot person is counted whole
    plan = salted_df._jdf.queryExecution().executedPlan().toString()
    assert "explode" in plan.lower()


def test_defs_json_round_trip(es_dict):
    es, _ = es_dict
    defs = plan_features(es, REFERENCE_CONFIG)
    back, cfg = defs_from_json(defs_to_json(defs, REFERENCE_CONFIG))
    assert back == defs and cfg == REFERENCE_CONFIG
    assert any(d.display == "MEAN(measurement.value_as_number WHERE measurement_concept_id = 100)"
               for d in defs)


def test_partition_count_changes_nothing(es_dict):
    es, _ = es_dict
    cfg = FeatureConfig("person", REFERENCE_CONFIG.children, (), None)
    defs = plan_features(es, cfg)
    a = feature_matrix(es, cfg, CUTOFF, defs=defs).matrix.collect()
    es2 = es.with_table("measurement", es["measurement"].repartition(7))
    b = feature_matrix(es2, cfg, CUTOFF, defs=defs).matrix.collect()
    ra, rb = ({r["person_id"]: r.asDict() for r in x} for x in (a, b))
    assert ra.keys() == rb.keys()
    for p in ra:   # float sums may differ in the last bit with another partitioning
        for k, v in ra[p].items():
            w = rb[p][k]
            assert close(v, w) if isinstance(v, float) else v == w, (p, k)


def test_pandas_cross_check(spark):
    """A1-A6 against pandas groupby on a random frame (fixed seed)."""
    rng = np.random.default_rng(7)
    n = 400
    pdf = pd.DataFrame({
        "row_id": np.arange(n), "pid": rng.integers(0, 25, n),
        "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 50, n), unit="D"),
        "v": np.where(rng.random(n) < 0.1, np.nan, rng.normal(10, 3, n).round(2))})
    sdf = spark.createDataFrame(
        [(int(a), int(b), c.to_pydatetime(), None if np.isnan(d) else float(d)) for a, b, c, d in
         pdf.itertuples(index=False)], "row_id long, pid long, ts timestamp_ntz, v double")
    from cohortlens import schemas as S
    from cohortlens.sources.entityset import EntitySet
    spec = S.TableSpec("x", (S.Col("row_id", S.INDEX), S.Col("pid", S.ID), S.Col("ts", S.TIME_INDEX),
                             S.Col("v", S.NUMERIC)), key="row_id", time_index="ts", person_key="pid")
    people = spark.createDataFrame([(i,) for i in range(25)], "pid long")
    pspec = S.TableSpec("p", (S.Col("pid", S.INDEX),), key="pid", person_key="pid")
    es = EntitySet("x", {"p": people, "x": sdf}, {"p": pspec, "x": spec})
    cfg = FeatureConfig("p", (ChildConfig("x", ("mean", "max", "min", "std", "skew", "last"), ("v",)),), (), None)
    got = rows_by_person(feature_matrix(es, cfg, "2030-01-01").matrix, "pid")
    g = pdf.sort_values(["ts", "row_id"]).groupby("pid")["v"]
    exp = pd.DataFrame({"mean": g.mean(), "max": g.max(), "min": g.min(), "std": g.std(),
                        "skew": g.skew(),
                        "last": pdf.sort_values(["ts", "row_id"]).groupby("pid").tail(1).set_index("pid")["v"]})
    for pid, row in exp.iterrows():
        for prim in ("mean", "max", "min", "std", "skew", "last"):
            e = None if pd.isna(row[prim]) else float(row[prim])
            assert close(got[pid][f"x__{prim}__v"], e, 1e-7), (pid, prim)


def test_pandas_cross_check_time_and_extra(spark):
    """A7-A10 and X1-X4, X6, X8-X10 against pandas on a random frame with ties
    in time and persons without rows."""
    from cohortlens import schemas as S
    from cohortlens.sources.entityset import EntitySet
    rng = np.random.default_rng(9)
    n = 500
    pdf = pd.DataFrame({
        "row_id": np.arange(n), "pid": rng.integers(0, 30, n),
        "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 2000, n), unit="h"),
        "v": np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 15, n).astype(float))})
    sdf = spark.createDataFrame(
        [(int(a), int(b), c.to_pydatetime(), None if np.isnan(d) else float(d)) for a, b, c, d in
         pdf.itertuples(index=False)], "row_id long, pid long, ts timestamp_ntz, v double") \
        .withColumn("hi", F.col("v") > F.lit(7.0)).repartition(3)
    spec = S.TableSpec("x", (S.Col("row_id", S.INDEX), S.Col("pid", S.ID), S.Col("ts", S.TIME_INDEX),
                             S.Col("v", S.NUMERIC)), key="row_id", time_index="ts", person_key="pid")
    people = spark.createDataFrame([(i,) for i in range(35)], "pid long")   # 30-34: no rows
    pspec = S.TableSpec("p", (S.Col("pid", S.INDEX),), key="pid", person_key="pid")
    es = EntitySet("x", {"p": people, "x": sdf, "b": sdf}, {"p": pspec, "x": spec, "b": spec})
    cut = "2021-01-01 00:00:00"
    cfg = FeatureConfig("p", (
        ChildConfig("x", ("time_since_last", "time_since_first", "count", "avg_time_between", "sum",
                          "median", "mode", "num_unique", "first", "trend"), ("v",)),
        ChildConfig("b", ("any", "all", "num_true", "percent_true"), ("hi",))), (), None)
    got = rows_by_person(feature_matrix(es, cfg, cut).matrix, "pid")
    c = pd.Timestamp(cut)
    ordered = pdf.sort_values(["ts", "row_id"])
    for pid in range(35):
        rows = ordered[ordered.pid == pid]
        g = got[pid]
        if rows.empty:
            assert g["x__count"] == 0 and g["b__num_true__hi"] == 0
            assert g["x__time_since_last"] is None and g["x__median__v"] is None
            continue
        v = rows["v"].dropna()
        assert g["x__count"] == len(rows)
        assert close(g["x__time_since_last"], (c - rows.ts.max()).total_seconds())
        assert close(g["x__time_since_first"], (c - rows.ts.min()).total_seconds())
        gaps = rows.ts.diff().dt.total_seconds().dropna()
        assert close(g["x__avg_time_between"], float(gaps.mean()) if len(gaps) else None)
        assert close(g["x__sum__v"], float(v.sum()) if len(v) else None)
        assert close(g["x__median__v"], float(v.median()) if len(v) else None)
        mode = v.value_counts().sort_index().idxmax() if len(v) else None
        assert g["x__mode__v"] == mode
        assert g["x__num_unique__v"] == v.nunique()
        first = rows["v"].iloc[0]
        assert close(g["x__first__v"], None if np.isnan(first) else float(first))
        pairs = rows.dropna(subset=["v"])
        days = (pairs.ts - pd.Timestamp("1970-01-01")).dt.total_seconds() / 86400.0
        slope = np.polyfit(days, pairs.v, 1)[0] if len(pairs) >= 2 and days.nunique() > 1 else None
        assert close(g["x__trend__v"], None if slope is None else float(slope), 1e-6), pid
        hi = (v > 7.0)
        assert g["b__any__hi"] == (bool(hi.any()) if len(v) else None)
        assert g["b__all__hi"] == (bool(hi.all()) if len(v) else None)
        assert g["b__num_true__hi"] == int(hi.sum())
        assert close(g["b__percent_true__hi"], float(hi.mean()) if len(v) else None)


def test_distribution_primitives(spark, es_dict):
    es, _ = es_dict
    cfg = FeatureConfig("person", (ChildConfig("measurement", ("n_most_common", "entropy"), (),
                                               ("measurement_concept_id",)),), (), None)
    got = rows_by_person(feature_matrix(es, cfg, CUTOFF).matrix)
    # person 1 before the cutoff: concept 100 three times, 200 once
    assert [got[1][f"measurement__n_most_common__measurement_concept_id__{i}"] for i in range(3)] == [100, 200, None]
    p = [0.75, 0.25]
    assert close(got[1]["measurement__entropy__measurement_concept_id"], -sum(x * math.log(x) for x in p))
    assert got[2]["measurement__entropy__measurement_concept_id"] == 0.0
    assert got[4]["measurement__entropy__measurement_concept_id"] is None


def test_median_and_mode_two_phase(spark):
    from cohortlens.operators.grouping import grouped_median, grouped_mode
    rng = np.random.default_rng(3)
    n = 3000
    # one hot group with ~1/3 of the rows spread over many partitions
    pid = np.where(rng.random(n) < 0.35, 0, rng.integers(1, 40, n))
    v = rng.integers(0, 30, n).astype(float)
    pdf = pd.DataFrame({"pid": pid, "v": v})
    sdf = spark.createDataFrame(pdf).repartition(9)
    med = {r.pid: r.median for r in grouped_median(sdf, ["pid"], "v", n_partitions=7).collect()}
    mode = {r.pid: r.mode for r in grouped_mode(sdf, ["pid"], "v").collect()}
    exp_med = pdf.groupby("pid")["v"].median()
    exp_mode = pdf.groupby("pid")["v"].agg(lambda s: s.value_counts().sort_index().idxmax())
    assert set(med) == set(exp_med.index)
    for p in exp_med.index:
        assert close(med[p], exp_med[p]), p
        assert mode[p] == exp_mode[p], p


def test_single_scan_matches_two_aggregations(spark, es_dict):
    """Hash-only primitives take the grouping-sets path; compare with the long form."""
    es, _ = es_dict
    prims = ("mean", "max", "count", "time_since_last")
    cfg = FeatureConfig("person", (ChildConfig("measurement", prims, ("value_as_number",), (),
                                               "measurement_concept_id", prims),), (), None)
    defs = plan_features(es, cfg)
    wide = rows_by_person(feature_matrix(es, cfg, CUTOFF, defs=defs, layout="wide").matrix)
    mp = rows_by_person(feature_matrix(es, cfg, CUTOFF, defs=defs, layout="map").matrix)
    res = feature_matrix(es, cfg, CUTOFF, defs=defs, layout="long")
    plain = rows_by_person(res.matrix)
    for r in res.long["measurement"].collect():
        p, c = r["person_id"], r["measurement_concept_id"]
        assert wide[p][f"measurement__count__where_{c}"] == r["measurement__count"]
        assert close(mp[p]["measurement__where_measurement_concept_id"][c]["measurement__mean__value_as_number"],
                     r["measurement__mean__value_as_number"])
    for p, row in plain.items():
        assert wide[p]["measurement__count"] == row["measurement__count"]
        assert close(wide[p]["measurement__mean__value_as_number"], row["measurement__mean__value_as_number"])
        assert mp[p]["measurement__count"] == row["measurement__count"]
    assert wide[4]["measurement__count__where_100"] == 0          # no rows -> count 0
    assert mp[4]["measurement__where_measurement_concept_id"] is None


def test_pivot_paths_agree(spark, monkeypatch):
    from cohortlens.operators import grouping
    df = spark.createDataFrame([(1, "a", 1.0, 5), (1, "b", 2.0, None), (2, "a", 3.0, 7)],
                               "p long, c string, x double, y long")
    cells = [(v, s, f"{s}_{v}") for v in ("a", "b", "z") for s in ("x", "y")]
    small = sorted(grouping.pivot_rows(df, ["p"], "c", cells).collect())
    monkeypatch.setattr(grouping, "MANUAL_PIVOT_CELLS", 2)
    big = grouping.pivot_rows(df, ["p"], "c", cells)
    assert sorted(big.select(*small[0].__fields__).collect()) == small
    assert small[0].asDict() == {"p": 1, "x_a": 1.0, "y_a": 5, "x_b": 2.0, "y_b": None, "x_z": None, "y_z": None}


def test_pivot_partial_grid_keeps_names(spark, monkeypatch):
    """Cells that are not the full value x statistic grid take the per-column
    rename; both paths name every cell as asked."""
    from cohortlens.operators import grouping
    df = spark.createDataFrame([(1, "a", 1.0, 5), (1, "b", 2.0, 6), (2, "a", 3.0, 7)],
                               "p long, c string, x double, y long")
    cells = [("a", "x", "xa"), ("b", "y", "yb"), ("a", "y", "ya")]
    small = sorted(grouping.pivot_rows(df, ["p"], "c", cells).collect())
    monkeypatch.setattr(grouping, "MANUAL_PIVOT_CELLS", 1)
    big = grouping.pivot_rows(df, ["p"], "c", cells)
    assert big.columns == ["p", "xa", "yb", "ya"]
    assert sorted(big.select(*small[0].__fields__).collect()) == small
    assert small[0].asDict() == {"p": 1, "xa": 1.0, "yb": 6, "ya": 5}


def codes(spark, es_dict, children, layout, **kw):
    es, _ = es_dict
    return feature_matrix(es, FeatureConfig("person", tuple(children)), CUTOFF, layout=layout, label=False, **kw)


def test_distribution_primitives_per_code_in_all_layouts(spark, es_dict):
    m, v, c = "measurement", "value_as_number", "measurement_concept_id"
    prims = ("median", "mode", "entropy", "n_most_common", "count")
    child = ChildConfig(m, (), (v,), (), c, prims, n_most_common=2)
    es, _ = es_dict
    wide = codes(spark, es_dict, [child], "wide")
    got = rows_by_person(wide.matrix)
    long = codes(spark, es_dict, [child], "long").long[m].collect()
    maps = rows_by_person(codes(spark, es_dict, [child], "map").matrix)
    assert long and {d.primitive for d in wide.defs} == set(prims)
    names = [f"{m}__median__{v}", f"{m}__mode__{v}", f"{m}__entropy__{v}"]
    for r in long:
        for n in names:
            assert close(got[r.person_id][f"{n}__where_{r[c]}"], r[n])
            assert close(maps[r.person_id][f"{m}__where_{c}"][r[c]][n], r[n])
        for i in range(2):
            assert got[r.person_id][f"{m}__n_most_common__{v}__where_{r[c]}__{i}"] == r[f"{m}__n_most_common__{v}__{i}"]
    # only the one code that is asked for, in the long layout too
    one = long[0][c]
    part = codes(spark, es_dict, [ChildConfig(m, (), (v,), (), c, ("max", "median"), (one,))], "long").long[m].collect()
    assert {r[c] for r in part} == {one}


def test_two_condition_columns_of_a_table(spark, es_dict):
    m, v, c = "measurement", "value_as_number", "measurement_concept_id"
    a, b = ChildConfig(m, ("max",), (v,), (), c, ("count",)), ChildConfig(m, ("min",), (v,), (), v, ("count",))
    both = rows_by_person(codes(spark, es_dict, [a, b], "map").matrix)
    for child, wc, n in ((a, c, "max"), (b, v, "min")):
        for k, r in rows_by_person(codes(spark, es_dict, [child], "map").matrix).items():
            assert both[k][f"{m}__where_{wc}"] == r[f"{m}__where_{wc}"] and both[k][f"{m}__{n}__{v}"] == r[f"{m}__{n}__{v}"]
    wide = codes(spark, es_dict, [a, b], "wide")
    assert len({d.name for d in wide.defs}) == len(wide.defs) and set(d.name for d in wide.defs) <= set(wide.matrix.columns)


def test_long_and_map_take_any_number_of_codes(spark, es_dict, monkeypatch):
    from cohortlens.operators import grouping
    monkeypatch.setattr(grouping.distinct_values, "__defaults__", (1,))
    child = ChildConfig("measurement", (), ("value_as_number",), (), "measurement_concept_id", ("max",))
    with pytest.raises(ValueError):
        codes(spark, es_dict, [child], "wide")
    assert len({r.measurement_concept_id for r in codes(spark, es_dict, [child], "long").long["measurement"].collect()}) > 1
    assert any(len(x or ()) for x, in codes(spark, es_dict, [child], "map").matrix.select("measurement__where_measurement_concept_id").collect())
