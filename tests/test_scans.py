"""Scans of minutes against searches on arrays and edited copies."""

import random

import pytest

from stopgraph.operators import arrivals, edits, local, scans

CONN = "trip int, seq int, from_stop int, to_stop int, dep int, arr int, route_int int, mode int"
OD = "q_id int, src int, dst int, t_dep int"


@pytest.fixture(scope="module")
def city(spark, tmp_path_factory):
    """Trips of many minutes and of none, several connections in a minute, chains of more than eight vehicles."""
    rng, rows = random.Random(6), []
    for trip in range(90):
        t = rng.randint(0, 120)
        for seq in range(4):
            ride = rng.choice([0, 0, 1, 4, 9])
            rows.append((trip * 3, seq, rng.randrange(15), rng.randrange(15), t, t + ride, trip % 5, 0))
            t += ride + rng.choice([0, 0, 2])
    rows += [(1000 + k, 0, 100 + k, 101 + k, 10 + 5 * k, 13 + 5 * k, 0, 0) for k in range(14)]
    path = str(tmp_path_factory.mktemp("minutes") / "conn")
    spark.createDataFrame(rows, CONN).write.parquet(path)
    walks = spark.createDataFrame([(k, (k + 4) % 15, 3) for k in range(0, 15, 2)] + [(0, 100, 2)], "u int, v int, w int")
    od = spark.createDataFrame([(q, rng.randrange(16), rng.randrange(15), rng.randint(0, 100)) for q in range(40)] + [(90, 100, 114, 0), (91, 777, 777, 5), (92, 777, 3, 5)], OD)
    return spark.read.parquet(path), walks, od


def test_minutes_equal_arrays(spark, city, monkeypatch):
    """Before, timetables beyond the bound went by rounds, a few jobs for each trip boarded; with one label's memory queries go one by one."""
    conn, walks, od = city
    want = sorted(map(tuple, local.earliest(conn, walks, od).collect()), key=str)
    whole = sorted(map(tuple, local.one_to_all(conn, walks, od).collect()))
    monkeypatch.setattr(local, "MOST", 3)
    monkeypatch.setattr(scans, "HELD", 1)
    monkeypatch.delattr(arrivals, "labels")
    assert sorted(map(tuple, arrivals.answer(conn, walks, od).collect()), key=str) == want
    got = sorted(map(tuple, arrivals.reach_all(conn, walks, od).collect()))
    assert [r for r in got if r[1] not in (15, 777)] == whole and [r for r in got if r[1] == 777] == [(91, 777, 5), (92, 777, 5)]
    assert max(t for q, s, t in got if q == 90) == 78  # fourteen boardings


def test_sets_over_minutes_equal_edited_copies(spark, city, monkeypatch):
    conn, walks, od = city
    rng, log = random.Random(8), []
    for k in range(40):
        kind = rng.choice(["DELAY", "CANCELLATION", "ADDITION"])
        trip, added = rng.choice([3 * rng.randrange(90), 5001]), kind == "ADDITION"
        log.append((k % 2, k, kind, None if added else trip, rng.randint(-9, 30) if kind == "DELAY" else None, trip if added else None, rng.randint(0, 150) if added else None, True))
    log = spark.createDataFrame(log, edits.EDIT_SCHEMA)
    want = sorted(map(tuple, arrivals.answer_edit_sets(conn, walks, od, log, 3).collect()), key=str)
    monkeypatch.setattr(local, "MOST", 3)
    monkeypatch.delattr(arrivals, "labels")
    assert sorted(map(tuple, arrivals.answer_edit_sets(conn, walks, od, log, 3).collect()), key=str) == want


def test_trips_that_go_back_are_not_scanned(spark, city):
    conn, walks, _ = city
    assert scans.slices(conn, walks) is not None
    assert scans.slices(conn.union(spark.createDataFrame([(7777, 0, 1, 2, 9, 10, 0, 0), (7777, 1, 2, 3, 8, 12, 0, 0)], CONN)), walks) is None


def test_arms_are_drawn_once(spark, city, monkeypatch):
    """Before, each arm read and ranked all trips again."""
    conn, _, _ = city
    arms = [("DELAY", 2), ("CANCELLATION", 5), ("ADDITION", 1)]
    want = list(tuple(r) for k, (kind, n) in enumerate(arms) for r in edits.build_edit_set(conn, kind, n, 42, k).collect())
    calls, drawn = [], edits._drawn
    monkeypatch.setattr(edits, "_drawn", lambda *a: calls.append(a) or drawn(*a))
    assert sorted(map(tuple, edits.build_edit_sets(conn, arms, 42).collect()), key=str) == sorted(want, key=str) and len(calls) == 1
