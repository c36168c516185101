"""Prolonged contacts, batch and stream, against a plain loop over all pairs of sightings."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest

from cohortlens.operators import contacts
from cohortlens.operators.contacts import contact_sessions, moments, sightings
from cohortlens.streaming.contacts import SIGHTING, close_sightings, read_contacts, stream_contacts

DAY = dt.datetime(2024, 3, 1)
NEAR, GAP = 600, 1800


def brute(rows, near=NEAR, gap=GAP, least=900):
    """{(a, b, started, ended, moments)} from all pairs."""
    met = defaultdict(list)
    for i, (p, place, t) in enumerate(rows):
        for q, other, u in rows[i + 1:]:
            if None not in (p, q, place, t, u) and place == other and p != q and abs((t - u).total_seconds()) <= near:
                met[min(p, q), max(p, q)].append((max(t, u), min(t, u)))
    out = set()
    for (a, b), ms in met.items():
        ms.sort()
        run = []
        for m in [*ms, None]:
            if run and (m is None or (m[0] - run[-1][0]).total_seconds() >= gap):
                first, last = min(e for _, e in run), run[-1][0]
                if (last - first).total_seconds() > least:
                    out.add((a, b, first, last, len(run)))
                run = []
            run.append(m)
    return out


def random_rows(n, seed, people=12, places=3, minutes=2000):
    rng = random.Random(seed)
    return [(f"p{rng.randrange(people):02}", f"x{rng.randrange(places)}", DAY + dt.timedelta(seconds=60 * rng.randrange(minutes) + rng.choice([0, 0, 7]),
                                                                                            microseconds=rng.choice([0, 3]))) for _ in range(n)]


def result(df):
    rows = df.collect()
    assert all(abs(r.seconds - (r.ended - r.started).total_seconds()) < 1e-6 for r in rows)
    return {(r.a, r.b, r.started, r.ended, r.moments) for r in rows}


@pytest.mark.parametrize("cell_rows", [4096, 5])
def test_sessions_match_all_pairs(spark, cell_rows):
    rows = random_rows(500, 4) + [(None, "x0", DAY), ("p00", None, DAY), ("p01", "x0", None)]
    got = contact_sessions(spark.createDataFrame(rows, SIGHTING), "person", "place", "time", NEAR, GAP, cell_rows=cell_rows)
    want = brute(rows)
    assert want and result(got) == want


def test_edges_of_near_gap_and_least(spark):
    def at(*seconds):
        return [DAY + dt.timedelta(seconds=s) for s in seconds]

    rows = [("a", "x", t) for t in at(0, 600, 1200)] + [("b", "x", t) for t in at(600, 1201)]
    rows += [("c", "y", t) for t in at(0, 1800, 3600)] + [("d", "y", t) for t in at(0, 1800, 3600)]  # moments exactly a gap apart
    rows += [("e", "z", t) for t in at(-700, 0, 300)] + [("f", "z", t) for t in at(-100, 300)]  # over the epoch of no cell; 900 s or more
    rows = [(p, x, t) for p, x, t in rows]
    want = brute(rows)
    assert result(contact_sessions(spark.createDataFrame(rows, SIGHTING), "person", "place", "time", NEAR, GAP)) == want
    assert {w[:2] for w in want} == {("a", "b"), ("e", "f")}
    with pytest.raises(ValueError):
        contact_sessions(spark.createDataFrame(rows, SIGHTING), "person", "place", "time", 600, 600)
    assert contact_sessions(spark.createDataFrame([], SIGHTING), "person", "place", "time", NEAR, GAP).count() == 0


def test_weak_signals_meet_nobody(spark):
    rows = [("a", "x", DAY + dt.timedelta(minutes=m), s) for m, s in ((0, -60.0), (10, -60.0), (20, -60.0))]
    rows += [("b", "x", DAY + dt.timedelta(minutes=m), s) for m, s in ((0, -60.0), (10, -95.0), (20, -60.0))] + [("c", "x", DAY, None)]
    df = spark.createDataFrame(rows, "person string, place string, time timestamp_ntz, rssi double")
    got = contact_sessions(df, "person", "place", "time", NEAR, GAP, signal="rssi", least_signal=-70.0)
    assert result(got) == brute([r[:3] for r in rows if (r[3] or -99) >= -70])


def test_crowded_place_is_split(spark):
    """Two thirds of all sightings in one place and cell: split, and each pair of them met once."""
    rows = [(f"p{i:03}", "hall", DAY + dt.timedelta(seconds=i % 500)) for i in range(200)] + random_rows(100, 9)
    seen = sightings(spark.createDataFrame(rows, SIGHTING), "person", "place", "time", NEAR)
    met = moments(seen, NEAR, cell_rows=16)
    assert met.where("a LIKE 'p%' AND b LIKE 'p%' AND length(a) = 4 AND length(b) = 4").count() == 200 * 199 // 2
    assert sorted(met.collect()) == sorted(moments(seen, NEAR).collect())


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_moments_are_never_exchanged(spark, broadcast):
    """Moments grow with the square of the sightings: with a broadcast or without, what finds them and their sessions is one stage."""
    rows = random_rows(500, 6) + [("busy", "x1", DAY + dt.timedelta(minutes=4 * m)) for m in range(250)]  # a third of all
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = contact_sessions(spark.createDataFrame(rows, SIGHTING), "person", "place", "time", NEAR, GAP, cell_rows=4)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and "Window" not in plan
        assert ("CartesianProduct" in plan) == (broadcast == "-1")
        assert result(got) == brute(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_sessions_over_slices_of_moments(spark, monkeypatch):
    """A task that holds few moments at once finds the sessions that it finds with all of them."""
    rows = random_rows(300, 8)
    df = sightings(spark.createDataFrame(rows, SIGHTING), "person", "place", "time", NEAR)
    batch = contacts.block_pairs(df, 1000).toArrow().combine_chunks().to_batches()[0]
    x, y = contacts.Block.of(batch, "x", 0), contacts.Block.of(batch, "y", 0)
    for most in (1, 7, 10**6):
        monkeypatch.setattr(contacts._met, "__defaults__", (most,))
        for wide in (False, True):  # by one sorted number, or by the pair where they would not fit it
            if wide:
                monkeypatch.setattr(contacts, "_by_pair", lambda pair, pairs: np.argsort(pair, kind="stable"))
            parts = [*contacts._sessions(x, y, True, NEAR * 10**6, GAP * 10**6, 900 * 10**6)]
            pair, first, last, n = (np.concatenate(c) for c in zip(*parts))
            p, q = np.divmod(pair, len(y.persons))
            at = np.datetime64(0, "us")
            assert {(x.persons[int(i)].as_py(), y.persons[int(j)].as_py(), (at + f).item(), (at + t).item(), int(k)) for i, j, f, t, k in zip(p, q, first, last, n)} == brute(rows)
        monkeypatch.undo()


# -- stream -------------------------------------------------------------------

def put(spark, rows, landing):
    spark.createDataFrame(rows, SIGHTING).coalesce(1).write.mode("append").parquet(landing)


@pytest.fixture
def utc_batches():
    """Sightings in order of arrival, at most 20 minutes out of order, in files."""
    rng = random.Random(11)
    rows = sorted(random_rows(300, 5, minutes=1500), key=lambda r: r[2] + dt.timedelta(minutes=rng.randrange(20)))
    return [rows[i:i + 75] for i in range(0, 300, 75)]


def test_stream_equals_batch_after_restarts(spark, tmp_path, utc_batches):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    every = [r for b in utc_batches for r in b]
    for n, rows in enumerate(utc_batches):  # every call is a new query on the same state: a restart
        put(spark, rows, landing)
        assert stream_contacts(spark, landing, out, NEAR, GAP, "30 minutes") == 0
        done = result(read_contacts(spark, out)) if n else set()
        assert done <= brute(every)  # what is written is final
    close_sightings(spark, landing, DAY + dt.timedelta(days=400))
    stream_contacts(spark, landing, out, NEAR, GAP, "30 minutes")
    want = brute(every)
    assert want and result(read_contacts(spark, out)) == want
    batch = contact_sessions(spark.createDataFrame(every, SIGHTING), "person", "place", "time", NEAR, GAP)
    assert result(batch) == want
    assert stream_contacts(spark, landing, out, NEAR, GAP, "30 minutes") == 0  # nothing new: nothing twice
    assert read_contacts(spark, out).count() == len(want)


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    early = [("a", "x", DAY + dt.timedelta(minutes=m)) for m in (0, 8, 16, 24)] + [("b", "x", DAY + dt.timedelta(minutes=m)) for m in (1, 9, 17, 25)]
    put(spark, early, landing)
    stream_contacts(spark, landing, out, NEAR, GAP, "10 minutes")
    put(spark, [("a", "far", DAY + dt.timedelta(hours=9))], landing)  # the watermark follows
    stream_contacts(spark, landing, out, NEAR, GAP, "10 minutes")
    late = [("c", "x", DAY + dt.timedelta(minutes=m)) for m in (2, 10, 18)]
    put(spark, late, landing)
    assert stream_contacts(spark, landing, out, NEAR, GAP, "10 minutes") == 3
    close_sightings(spark, landing, DAY + dt.timedelta(days=400))
    stream_contacts(spark, landing, out, NEAR, GAP, "10 minutes")
    assert result(read_contacts(spark, out)) == brute(early)
    assert spark.read.parquet(out + "/_late").selectExpr("sum(late_rows)").first()[0] == 3
