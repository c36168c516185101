"""Feature planner: several cutoffs a person, injective names, typed codes, unknown names, many codes."""

import datetime as dt
import decimal
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.operators.asof import MERGEABLE, asof_aggregates
from cohortlens.operators.grouping import safe_token
from cohortlens.operators.sparse import from_sparse
from cohortlens.plans.features import ChildConfig, FeatureConfig, feature_matrix, plan_features
from cohortlens.sources.entityset import from_frames

CUT = "2024-06-01"


def table_set(spark, rows, code_type="long", persons=range(1, 6)):
    """Persons and their events ``(id, person, time, value, code)``."""
    people = spark.createDataFrame([(p,) for p in persons], "pid long")
    events = spark.createDataFrame(rows, f"eid long, pid long, at timestamp_ntz, v double, code {code_type}")
    specs = {"p": S.TableSpec("p", (S.Col("pid", S.INDEX),), key="pid", person_key="pid"),
             "e": S.TableSpec("e", (S.Col("eid", S.INDEX), S.Col("gone", S.NUMERIC)), key="eid", time_index="at", person_key="pid")}
    return from_frames("s", {"p": people, "e": events}, specs, "p", "pid")


def day(n, h=0):
    return dt.datetime(2024, 1, 1, h) + dt.timedelta(days=n)


def config(*children):
    return FeatureConfig("p", tuple(children))


ROWS = [(i, 1 + i % 4 if i % 3 else 1, day((i * 7) % 60, i % 24), [1.0, 2.5, None, 7.0, 7.0][i % 5], [5, -5, None][i % 3]) for i in range(200)]


# -- several cutoffs ---------------------------------------------------------------

PRIMS = ("count", "mean", "sum", "max", "min", "std", "last", "first", "time_since_last", "time_since_first", "avg_time_between")


@pytest.mark.parametrize("layout", ["wide", "map", "long"])
def test_each_cutoff_sees_its_rows(spark, layout):
    es = table_set(spark, ROWS)
    days = {1: [10, 30, 100], 2: [0, 5], 3: [40], 4: [-5, 20], 5: [3, 4]}
    cuts = spark.createDataFrame([(p, day(d, 12)) for p, ds in days.items() for d in [*ds, ds[0]]], "person_id long, cutoff_time timestamp_ntz")
    cfg = config(ChildConfig("e", (*PRIMS, "skew", "median"), ("v",), (), "code", ("max", "count")))
    res = feature_matrix(es, cfg, cuts, layout=layout, many_cutoffs=True)
    got = {(r.pid, r.cutoff_time): r.asDict() for r in res.matrix.collect()}
    assert set(got) == {(p, day(d, 12)) for p, ds in days.items() for d in ds}
    for p, ds in days.items():
        for d in ds:
            one = feature_matrix(es, cfg, str(day(d, 12)), layout=layout).matrix.where(F.col("pid") == p).first().asDict()
            mine = got[p, day(d, 12)]
            assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in one.items()} == {k: v for k, v in mine.items() if k != "cutoff_time"}
    if layout == "long":
        assert {(r.pid, r.cutoff_time) for r in res.long["e"].collect()} <= set(got)


def test_asof_states_match_plain_lists(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), day(rng.randrange(50)), rng.choice([None, 1e6 + rng.random(), 3.0]), 0) for i in range(400)]
    es = table_set(spark, rows)
    cuts = [(p, day(d)) for p in (1, 2, 3, 9) for d in (-1, 0, 13, 27, 49, 80)]
    out = asof_aggregates(es["e"], spark.createDataFrame(cuts, "person_id long, cutoff_time timestamp_ntz"), "pid", "at", "eid",
                          [(p, None if p.startswith(("count", "time", "avg")) else "v", p) for p in sorted(MERGEABLE - {"any", "all", "num_true", "percent_true"})])
    got = out.collect()
    assert len(got) == len(cuts)
    for r in got:
        cut = r[out.columns[1]]
        mine = sorted((x for x in rows if x[1] == r.pid and x[2] <= cut), key=lambda x: (x[2], x[0]))
        v = [x[3] for x in mine if x[3] is not None]
        assert r["count"] == len(mine) and r["max"] == max(v, default=None) and r["min"] == min(v, default=None)
        assert r["last"] == (mine[-1][3] if mine else None) and r["first"] == (mine[0][3] if mine else None)
        assert r["mean"] == (pytest.approx(statistics.fmean(v)) if v else None)
        assert r["std"] == (pytest.approx(statistics.stdev(v), rel=1e-6) if len(v) > 1 else None)
        assert r["time_since_last"] == ((cut - mine[-1][2]).total_seconds() if mine else None)
        assert r["avg_time_between"] == (pytest.approx((mine[-1][2] - mine[0][2]).total_seconds() / (len(mine) - 1)) if len(mine) > 1 else None)
    with pytest.raises(ValueError):
        asof_aggregates(es["e"], spark.createDataFrame(cuts, "person_id long, cutoff_time timestamp_ntz"), "pid", "at", "eid", [("skew", "v", "s")])


def test_rows_are_read_once_for_all_cutoffs(spark, tmp_path):
    es = table_set(spark, ROWS)
    es["e"].write.parquet(str(tmp_path / "e"))
    es = es.with_table("e", spark.read.parquet(str(tmp_path / "e")), es.spec("e"))
    cuts = spark.createDataFrame([(p, day(d)) for p in range(1, 5) for d in range(40)], "person_id long, cutoff_time timestamp_ntz")
    m = feature_matrix(es, config(ChildConfig("e", PRIMS, ("v",))), cuts, many_cutoffs=True).matrix
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [eid") == 1


def test_repeated_person_without_many_cutoffs_is_refused(spark):
    es = table_set(spark, ROWS)
    cuts = spark.createDataFrame([(1, day(1)), (1, day(2))], "person_id long, cutoff_time timestamp_ntz")
    with pytest.raises(ValueError, match="several cutoffs"):
        feature_matrix(es, config(ChildConfig("e", ("count",))), cuts)
    with pytest.raises(ValueError):
        feature_matrix(es, config(ChildConfig("e", ("count",))), CUT, many_cutoffs=True)


# -- names and codes ----------------------------------------------------------------

def test_tokens_are_injective():
    values = [5, -5, 5.0, "5 ", " 5", "a b", "a_b", "a-b", "", "_x2D_5", "_x5F_x2D_5", "blank", "é", "minus5", "x2D_", "__x2D_"]
    assert len({safe_token(v) for v in values}) == len(values)
    assert safe_token("click") == "click" and safe_token(5) == "5" and safe_token("a_b") == "a_b"


def test_codes_of_one_token_are_two_columns(spark):
    es = table_set(spark, ROWS)
    m = feature_matrix(es, config(ChildConfig("e", (), ("v",), (), "code", ("count",))), CUT).matrix
    assert m.columns == ["pid", "e__count__where__x2D_5", "e__count__where_5"]
    want = {p: [sum(r[1] == p and r[4] == c for r in ROWS) for c in (-5, 5)] for p in range(1, 6)}
    assert {r[0]: [r[1], r[2]] for r in m.collect()} == want


@pytest.mark.parametrize("code_type", ["decimal(10,4)", "double", "boolean", "date", "string"])
@pytest.mark.parametrize("n", [2, 120])
def test_typed_codes_reach_their_columns(spark, code_type, n):
    """Also where the pivot has more cells than conditional aggregates are used for (120 codes x 3)."""
    make = {"decimal(10,4)": lambda i: decimal.Decimal(i) / 10000, "double": lambda i: i / 10000, "boolean": lambda i: i % 2 == 0,
            "date": lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i), "string": lambda i: f"{i} %"}[code_type]
    rows = [(i, 1 + i % 5, day(1), float(i), make(i % n + 1)) for i in range(300)]
    es = table_set(spark, rows, code_type)
    for prims in (("count", "mean", "max"), ("count", "last", "max")):  # one scan, and two aggregations
        res = feature_matrix(es, config(ChildConfig("e", ("count",), ("v",), (), "code", prims)), CUT)
        spec = {d.name: d for d in res.defs}
        for r in res.matrix.collect():
            for name, d in spec.items():
                mine = [x for x in rows if x[1] == r.pid and (d.where_column is None or x[4] == d.where_value)]
                stat = {"count": len, "mean": lambda x: sum(y[3] for y in x) / len(x) if x else None, "max": lambda x: max((y[3] for y in x), default=None),
                        "last": lambda x: max(x, key=lambda y: y[0])[3] if x else None}[d.primitive](mine)
                assert r[name] == stat, (name, r.pid)


def test_unknown_names_are_refused_and_dropped_columns_are_not(spark):
    es = table_set(spark, ROWS)
    bad = [config(ChildConfig("ee", ("count",))), config(ChildConfig("e", ("mean",), ("w",))), config(ChildConfig("e", (), ("v",), (), "kode", ("mean",))),
           config(ChildConfig("e", ("last",), (), ("c",))), FeatureConfig("p", (), ("sex",)), FeatureConfig("q"), FeatureConfig("p", (), (), "born")]
    for cfg in bad:
        with pytest.raises(ValueError, match="has no"):
            plan_features(es, cfg)
    assert [d.name for d in plan_features(es, config(ChildConfig("e", ("mean",), ("v", "gone"))))] == ["e__mean__v"]


def test_definitions_of_one_name_are_refused(spark):
    es = table_set(spark, ROWS)
    with pytest.raises(ValueError, match="both named"):
        plan_features(es, config(ChildConfig("e", ("n_most_common",), (), ("code",), n_most_common=2), ChildConfig("e", ("n_most_common",), (), ("code",), n_most_common=3)))


def test_vocabulary_belongs_to_one_condition_column(spark):
    es = table_set(spark, ROWS)
    es = es.with_table("e", es["e"].withColumn("kind", F.when(F.col("v") > 2, "hi").otherwise("lo")), es.spec("e"))
    cfg = config(ChildConfig("e", (), ("v",), (), "code", ("max",)), ChildConfig("e", (), ("v",), (), "kind", ("max",)))
    names = {d.name for d in plan_features(es, cfg, vocab={"e": [5]})}
    assert names == {"e__max__v__where_5", "e__max__v__where_kind_hi", "e__max__v__where_kind_lo"}
    assert {d.where_value for d in plan_features(es, cfg, vocab={("e", "kind"): ["lo"], ("e", "code"): [7]})} == {"lo", 7}


@pytest.mark.parametrize("layout", ["map", "long"])
@pytest.mark.parametrize("prims", [("mean", "max"), ("last", "max")])
def test_values_hold_per_primitive(spark, layout, prims):
    es = table_set(spark, ROWS)
    cfg = config(ChildConfig("e", (), ("v",), (), "code", prims[:1], (5,)), ChildConfig("e", (), ("v",), (), "code", prims[1:], (-5,)))
    res = feature_matrix(es, cfg, CUT, layout=layout)
    rows = (res.long["e"] if layout == "long" else res.matrix.select("pid", F.explode("e__where_code").alias("code", "v")).select("pid", "code", "v.*")).collect()
    assert {r.code for r in rows} == {5, -5}
    for r in rows:
        assert (r[f"e__{prims[0]}__v"] is None) == (r.code != 5) and (r[f"e__{prims[1]}__v"] is None) == (r.code != -5)


# -- many codes -------------------------------------------------------------------

def test_sparse_layout_has_no_bound_on_codes(spark):
    rows = [(i, 1 + i % 3, day(1), float(i % 7) if i % 11 else None, i // 2) for i in range(24_000)]
    es = table_set(spark, rows)
    res = feature_matrix(es, config(ChildConfig("e", ("count",), ("v",), (), "code", ("count", "mean"))), CUT, layout="sparse")
    assert res.matrix.columns == ["pid", "e__count", "e__where_code"] and res.dictionaries["e__where_code"].count() == 24_000
    got = from_sparse(res.matrix, ["pid"], "e__where_code", res.dictionaries["e__where_code"])
    long = feature_matrix(es, config(ChildConfig("e", (), ("v",), (), "code", ("count", "mean"))), CUT, layout="long").long["e"]
    want = {(r.pid, r.code, s): float(r[s]) for r in long.collect() for s in ("e__count", "e__mean__v") if r[s] is not None}
    assert {(r.pid, r.code, r.statistic): r.value for r in got.collect()} == want and len(want) > 24_000
    vectors = [r[0].indices for r in res.matrix.select("e__where_code").collect() if r[0]]
    assert all(v == sorted(set(v)) for v in vectors) and max(map(max, vectors)) == 23_999
