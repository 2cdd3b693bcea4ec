"""Links kept by stop and slot and repaired, against the event graph of the edited timetable."""

import os
import random

import pytest

from stopgraph.operators import edits as E
from stopgraph.operators import graphs as G
from stopgraph.operators import links as K

CONN = "trip int, seq int, from_stop int, to_stop int, dep int, arr int, route_int int, mode int"


@pytest.fixture(scope="module")
def city(spark, tmp_path_factory):
    rng, rows = random.Random(5), []
    for trip in range(90):
        t, stop = rng.choice([rng.randint(0, 40), rng.randint(200, 300)]), rng.randrange(12)
        for seq in range(rng.randint(1, 5)):
            ride, to = rng.randint(1, 25), rng.randrange(12)
            rows.append((trip, seq, stop, to, t, t + ride, trip % 7, 0))
            t, stop = t + ride + rng.randint(0, 2), to
    path = str(tmp_path_factory.mktemp("city") / "conn")
    spark.createDataFrame(rows, CONN).write.parquet(path)
    walks = spark.createDataFrame([(u, (u + 5) % 12, 6) for u in range(0, 12, 2)], "u int, v int, w int")
    return spark.read.parquet(path), walks


@pytest.fixture(autouse=True)
def few_partitions(monkeypatch):
    monkeypatch.setattr(K, "AREAS", 3)


def _edits(spark, rows):
    return spark.createDataFrame([(0, k, *r, True) for k, r in enumerate(rows)], E.EDIT_SCHEMA)


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _same(conn, walks, path):
    return sorted(K.edges(conn, path).collect()) == sorted(G.event_edges(conn, walks).collect())


def test_repairs_equal_rebuilding(spark, city, tmp_path):
    conn, walks = city
    path = str(tmp_path / "kept")
    K.build(conn, walks, path)
    assert _same(conn, walks, path)
    first = _edits(spark, [("DELAY", 4, 9, None, None), ("CANCELLATION", 7, None, None, None), ("ADDITION", None, None, 12, 300)])
    second = _edits(spark, [("DELAY", 4, 9, None, None), *[("CANCELLATION", k, None, None, None) for k in range(40, 90)], ("ADDITION", None, None, 12, 650)])
    before = None
    for edits in (first, second, _edits(spark, [("RESTORE", 4, None, None, None)])):  # the last one takes all back
        gone, come = E.delta(conn, before, edits)
        for _ in range(2 if edits is first else 1):  # repeating a repair changes nothing
            K.repair(path, gone, come, walks)
            assert _same(E.apply_edits(conn, edits), walks, path)
        before = edits


def test_other_partitions_stay(spark, city, tmp_path):
    conn, walks = city
    path = str(tmp_path / "kept")
    K.build(conn, walks, path)
    files = _files(f"{path}/links")
    edits = _edits(spark, [("DELAY", 30, 2, None, None)])
    parts = K.repair(path, *E.delta(conn, None, edits), walks)
    stay = {f for f in files if not any(f"slot={s}/area={a}/" in f for s, a in parts)}
    assert stay and stay <= _files(f"{path}/links") and 0 < len(parts) < len({os.path.dirname(f) for f in files}) / 2
    assert K.repair(path, *E.delta(conn, edits, edits), walks) == []


def test_slots_without_departures(spark, tmp_path):
    """The last departure of a stop goes, its questions of hours before have no answer; one comes back far later."""
    rows = [(0, 0, 1, 2, 10, 20, 0, 0), (1, 0, 3, 1, 0, 5, 0, 0), (2, 0, 1, 2, 400, 410, 0, 0), (3, 0, 5, 1, 90, 100, 0, 0)]
    conn, walks, path = spark.createDataFrame(rows, CONN), spark.createDataFrame([(2, 1, 3)], "u int, v int, w int"), str(tmp_path / "kept")
    K.build(conn, walks, path)
    before = None
    for rows in ([("CANCELLATION", 2, None, None, None), ("CANCELLATION", 0, None, None, None)], [("DELAY", 2, 300, None, None)], [("CANCELLATION", k, None, None, None) for k in range(4)], [("DELAY", 0, -10, None, None)]):
        edits = _edits(spark, rows)
        K.repair(path, *E.delta(conn, before, edits), walks)
        assert _same(E.apply_edits(conn, edits), walks, path), rows
        before = edits


def test_a_row_a_stop_of_a_slot_at_the_ends_of_numbers(spark, tmp_path, monkeypatch):
    """Links lie and are shuffled as a row a stop of a slot; great stops and trips, minutes before 0 and walks of hours stay."""
    monkeypatch.setattr(K, "AREAS", 16)
    far, late = 2**31 - 1, 2**31 - 2
    rows = [(0, 0, far, 0, -32768, -32760, 0, 0), (late, 3, 0, far, -7, 32767, 0, 0), (late, 4, far, 0, 32767, 32767, 0, 0), *[(k, 0, 0, far, k % 15, 40 + k % 7, 0, 0) for k in range(1, 60)]]
    conn, walks, path = spark.createDataFrame(rows, CONN), spark.createDataFrame([(far, 0, 300), (0, far, 0)], "u int, v int, w int"), str(tmp_path / "kept")
    K.build(conn, walks, path)
    assert _same(conn, walks, path)
    kept = K.read(spark, path)
    assert kept.count() == kept.select("slot", "area", "stop").distinct().count()
    edits = _edits(spark, [("DELAY", 5, 9, None, None), ("CANCELLATION", late, None, None, None), ("ADDITION", None, None, 7, 300)])
    some = conn.where(f"trip <> {late}")  # an added trip needs a number after all others
    assert sorted(E.apply_edits_to_named(some, edits).collect()) == sorted(E.apply_edits(some, edits).collect())
    K.repair(path, conn.where(f"trip = {late}"), conn.limit(0), walks)
    assert _same(some, walks, path)
