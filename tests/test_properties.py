"""Properties of the feature matrix on random tables (hypothesis): row order,
partition count and rows after the cutoff change nothing."""

import datetime as dt

from hypothesis import HealthCheck, given, settings, strategies as st

from cohortlens import schemas as S
from cohortlens.plans.features import ChildConfig, FeatureConfig, feature_matrix
from cohortlens.sources.entityset import EntitySet

CUT = dt.datetime(2024, 1, 10)
BASE = dt.datetime(2024, 1, 1)

row = st.tuples(st.integers(0, 5),                      # person
                st.integers(0, 8 * 24),                 # hours after BASE (ties likely)
                st.one_of(st.none(), st.floats(-50, 50, allow_nan=False).map(lambda x: round(x, 2))),
                st.sampled_from([1, 2, 3, None]))       # code

SPEC = S.TableSpec("ev", (S.Col("eid", S.INDEX), S.Col("pid", S.ID), S.Col("ts", S.TIME_INDEX),
                          S.Col("v", S.NUMERIC), S.Col("code", S.CATEGORICAL)),
                   key="eid", time_index="ts", person_key="pid")
PSPEC = S.TableSpec("p", (S.Col("pid", S.INDEX),), key="pid", person_key="pid")
PRIMS = ("count", "mean", "max", "std", "last", "time_since_last")
CFG = FeatureConfig("p", (ChildConfig("ev", PRIMS, ("v",), (), "code", ("count", "mean", "last"),
                                      (1, 2, 3)),), (), None)


def _keyed(rows, first_key=0):
    return [(first_key + i, p, BASE + dt.timedelta(hours=h), v, c) for i, (p, h, v, c) in enumerate(rows)]


def _matrix(spark, data, partitions):
    ev = spark.createDataFrame(data, "eid long, pid long, ts timestamp_ntz, v double, code long") \
        .repartition(partitions)
    people = spark.createDataFrame([(i,) for i in range(6)], "pid long")
    es = EntitySet("h", {"p": people, "ev": ev}, {"p": PSPEC, "ev": SPEC})
    out = feature_matrix(es, CFG, "2024-01-10 00:00:00").matrix
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in out.collect())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, min_size=1, max_size=60), late=st.lists(row, max_size=10),
       parts=st.integers(1, 5), seed=st.randoms(use_true_random=False))
def test_order_partitions_and_late_rows_change_nothing(spark, rows, late, parts, seed):
    data = _keyed(rows)
    a = _matrix(spark, data, 1)
    shuffled = list(data)          # same keyed rows, another order and partitioning
    seed.shuffle(shuffled)
    assert _matrix(spark, shuffled, parts) == a
    after = _keyed([(p, 9 * 24 + h % 24 + 1, v, c) for p, h, v, c in late], len(data))
    assert _matrix(spark, shuffled + after, parts) == a    # all after the cutoff
