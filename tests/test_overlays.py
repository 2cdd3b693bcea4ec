"""Edit sets laid over one timetable, against edited copies of it searched apart."""

import random

import pytest

from stopgraph.operators import arrivals, edits, local

CONN = "trip int, seq int, from_stop int, to_stop int, dep int, arr int, route_int int, mode int"


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    rows = []
    for trip in range(60):
        t = rng.randint(0, 200)
        for seq in range(4):
            a = rng.randint(1, 20)
            rows.append((trip, seq, rng.randint(0, 12), rng.randint(0, 12), t, t + a, trip % 5, 0))
            t += a + rng.randint(0, 5)
    log = []
    for k in range(80):
        kind = rng.choice(["DELAY", "CANCELLATION", "ADDITION", "RESTORE"])
        trip = rng.choice([rng.randint(0, 59), 500])
        added = kind == "ADDITION"
        log.append((rng.randint(0, 3), k, kind, None if added else trip, rng.randint(-9, 30) if kind == "DELAY" else None, trip if added else None, rng.randint(0, 220) if added else None, rng.random() < 0.9))
    log.append((3, 900, "CANCEL_ADDED", 60, None, None, None, True))
    conn = spark.createDataFrame(rows, CONN)
    walks = spark.createDataFrame([(k, (k + 3) % 13, 4) for k in range(0, 13, 2)], "u int, v int, w int")
    od = spark.createDataFrame([(q, rng.randint(0, 13), rng.randint(0, 12), rng.randint(0, 150)) for q in range(30)], "q_id int, src int, dst int, t_dep int")
    return conn, walks, od, spark.createDataFrame(log, edits.EDIT_SCHEMA)


def test_overlays_are_the_edited_timetables(spark, world):
    conn, walks, od, log = world
    got = {(r.edit_set, r.q_id): r.ea for r in arrivals.answer_edit_sets(conn, walks, od, log, 6).collect()}
    assert len(got) == 6 * 30
    for k in range(6):
        copy = edits.apply_edits(conn, log.where(f"edit_set = {k}"))
        assert {q: ea for (s, q), ea in got.items() if s == k} == {r.q_id: r.ea for r in local.earliest(copy, walks, od).collect()}, k
    assert len({tuple(got[k, q] for q in range(30)) for k in range(6)}) > 3


def test_beyond_the_bound_sets_are_worlds(spark, world, monkeypatch):
    conn, walks, od, log = world
    few, some = od.where("q_id < 6"), log.where("edit_set < 2")
    want = sorted(map(tuple, arrivals.answer_edit_sets(conn, walks, few, some, 2).collect()))
    held = local.hold(conn, walks)
    monkeypatch.setattr(local, "MOST", 3)
    assert local.earliest_overlaid(held, few, some.select("edit_set", "trip_id"), conn) is None
    assert sorted(map(tuple, arrivals.answer_edit_sets(conn, walks, few, some, 2).collect())) == want


def test_no_edits_and_no_queries(spark, world):
    conn, walks, od, log = world
    plain = {r.q_id: r.ea for r in local.earliest(conn, walks, od).collect()}
    assert {r.q_id: r.ea for r in arrivals.answer_edit_sets(conn, walks, od, log.where("false"), 1).collect()} == plain
    assert arrivals.answer_edit_sets(conn, walks, od.where("false"), log, 2).count() == 0
    assert arrivals.answer_edit_sets(conn.where("false"), walks, od.where("src = dst"), log, 2).where("ea is null or ea <> t_dep").count() == 0
