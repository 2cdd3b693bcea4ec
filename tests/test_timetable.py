"""Hand-computed fixtures, random timetables against a plain scan, and edits."""

import random

import pytest
from pyspark.sql import functions as F

from stopgraph.operators import arrivals, edits, graphs, relational
from stopgraph.operators.closure import walk_closure
from stopgraph.sources import timetable
from stopgraph.streaming import edit_stream

CONN = "trip int, seq int, from_stop int, to_stop int, dep int, arr int, route_int int, mode int"
OD = "q_id int, src int, dst int, t_dep int"

#: id: connections (trip, seq, from, to, dep, arr), walks (u, v, w), queries (src, dst, t, answer)
FIXTURES = {
    "A1": ([], [(0, 1, 5)], [(0, 1, 0, 5), (1, 0, 0, None)]),
    "A2": ([], [(0, 1, 3), (1, 0, 3), (1, 2, 4), (2, 1, 4)], [(0, 2, 0, 7)]),
    "A3": ([], [(0, 1, 10), (1, 0, 10), (1, 2, 2), (2, 1, 2), (0, 2, 14), (2, 0, 14)], [(0, 2, 0, 12)]),
    "B1": ([(0, 0, 0, 1, 10, 15)], [], [(0, 1, 0, 15)]),
    "B2": ([(0, 0, 0, 1, 5, 10), (1, 0, 0, 1, 15, 20)], [], [(0, 1, 12, 20)]),
    "B3": ([(0, 0, 0, 1, 5, 10)], [], [(0, 1, 100, None)]),
    "C1": ([(0, 0, 0, 1, 0, 5), (0, 1, 1, 2, 5, 10)], [], [(0, 2, 0, 10)]),
    "C2": ([(0, 0, 0, 1, 0, 5), (0, 1, 1, 2, 6, 11), (0, 2, 2, 3, 12, 17)], [], [(1, 3, 0, 17)]),
    "D1": ([(0, 0, 0, 1, 0, 5), (1, 0, 2, 3, 10, 15)], [(1, 2, 3), (2, 1, 3)], [(0, 3, 0, 15)]),
    "D2a": ([(0, 0, 0, 1, 0, 5), (1, 0, 2, 3, 7, 12)], [(1, 2, 3), (2, 1, 3)], [(0, 3, 0, None)]),
    "E1": ([(0, 0, 0, 1, 0, 5)], [(1, 2, 3), (2, 1, 3)], [(0, 2, 0, 8)]),
    "F1": ([], [(0, 1, 5)], [(0, 0, 7, 7)]),
    "F2": ([(0, 0, 0, 1, 5, 10)], [], [(0, 1, 5, 10)]),
    "F3": ([(0, 0, 0, 1, 5, 10)], [], [(0, 1, 6, None)]),
    "F4a": ([], [(0, 1, 15)], [(0, 1, 0, 15)]),
    "F4b": ([], [(0, 1, 16)], [(0, 1, 0, None)]),
    "G1": ([(0, 0, 0, 1, 5, 10), (1, 0, 0, 1, 5, 8)], [], [(0, 1, 0, 8)]),
    "G2": ([(0, 0, 0, 1, 0, 3), (0, 1, 1, 2, 3, 7), (1, 0, 1, 2, 3, 6)], [], [(0, 2, 0, 6)]),
    "H1": ([(0, 0, 0, 1, 5, 10)], [(0, 1, 2)], [(0, 1, 0, 2)]),
    "N1": ([(0, 0, 0, 1, 5, 12), (1, 0, 2, 3, 20, 25)], [(0, 1, 10), (1, 2, 8)], [(0, 3, 0, 25)]),
    "N4": ([(0, 0, 0, 1, 0, 5), (0, 2, 2, 3, 12, 17)], [], [(0, 3, 0, 17)]),
}


def _all(spark):
    """All fixtures as one timetable: stops and trips of fixture k begin at 100 k."""
    conn, walk, od, want = [], [], [], {}
    for k, (c, w, q) in enumerate(FIXTURES.values()):
        conn += [(100 * k + t, s, 100 * k + a, 100 * k + b, d, e, 0, 0) for t, s, a, b, d, e in c]
        walk += [(100 * k + u, 100 * k + v, m) for u, v, m in w]
        for a, b, t, ea in q:
            od.append((len(od), 100 * k + a, 100 * k + b, t))
            want[len(od) - 1] = ea
    return spark.createDataFrame(conn, CONN), walk_closure(spark.createDataFrame(walk, "u int, v int, w int"), 15), spark.createDataFrame(od, OD), want


def test_fixtures(spark):
    conn, walks, od, want = _all(spark)
    got = {r.q_id: r.ea for r in arrivals.earliest(conn, walks, od).collect()}
    assert got == want
    edges = graphs.event_edges(conn, walks)
    assert {r.q_id: r.ea for r in graphs.earliest_on_events(conn, walks, od, edges).collect()} == want


def _scan(conn, walks, src, t0):
    """Scans in order of departure until nothing changes; walks only from rides and the source."""
    best = {src: t0}
    for u, v, w in walks:
        if u == src:
            best[v] = min(best.get(v, 9**9), t0 + w)
    while True:
        before, on = dict(best), set()
        for t, _, a, b, d, e, *_ in sorted(conn, key=lambda c: (c[0], c[1])):
            if t in on or best.get(a, 9**9) <= d:
                on.add(t)
                best[b] = min(best.get(b, 9**9), e)
                for u, v, w in walks:
                    if u == b:
                        best[v] = min(best.get(v, 9**9), e + w)
        if best == before:
            return best


def test_random_timetables(spark):
    rng = random.Random(5)
    conn, walks, od, want = [], [], [], {}
    for k in range(25):
        own, foot = [], []
        for trip in range(8):
            t, stop = rng.randint(0, 40), rng.randint(0, 6)
            for seq in range(rng.randint(1, 4)):
                nxt, d = rng.randint(0, 6), t + rng.randint(0, 3)
                t = d + rng.randint(0, 6)
                if nxt != stop:
                    own.append((100 * k + trip, seq, 100 * k + stop, 100 * k + nxt, d, t, 0, 0))
                stop = nxt
        for _ in range(4):
            a, b = rng.sample(range(7), 2)
            foot.append((100 * k + a, 100 * k + b, rng.randint(1, 9)))
        closed = {}
        for u, v, w in foot:
            closed[u, v] = min(w, closed.get((u, v), 99))
        for m in range(7):
            for a in range(7):
                for b in range(7):
                    x, y = closed.get((100 * k + a, 100 * k + m)), closed.get((100 * k + m, 100 * k + b))
                    if x and y and a != b and x + y < closed.get((100 * k + a, 100 * k + b), 99):
                        closed[100 * k + a, 100 * k + b] = x + y
        foot_closed = [(u, v, w) for (u, v), w in closed.items() if w <= 15]
        reach = _scan(own, foot_closed, 100 * k, 3)
        for dst in range(7):
            od.append((len(od), 100 * k, 100 * k + dst, 3))
            want[len(od) - 1] = reach.get(100 * k + dst)
        conn, walks = conn + own, walks + foot
    c, w = spark.createDataFrame(conn, CONN), walk_closure(spark.createDataFrame(walks, "u int, v int, w int"), 15)
    q = spark.createDataFrame(od, OD)
    got = {r.q_id: r.ea for r in arrivals.earliest(c, w, q).collect()}
    assert got == want
    two = {r.q_id: r.ea for r in arrivals.earliest(c, w, q, max_boardings=1).collect()}
    assert all(got[k] <= v for k, v in two.items() if v is not None)


@pytest.mark.parametrize(
    "conn, walk, edit, queries",
    [
        ([(1, 0, 0, 1, 0, 5), (2, 0, 0, 1, 10, 15)], [], (0, 1, "DELAY", 1, 3, None, None, True), [(0, 8), (6, 15)]),
        ([(1, 0, 0, 1, 30, 35)], [(0, 1, 8)], (0, 1, "ADDITION", None, None, 1, 0, True), [(0, 5)]),
        ([(1, 0, 0, 1, 0, 5)], [(0, 1, 7)], (0, 1, "CANCELLATION", 1, None, None, None, True), [(0, 7)]),
        ([(1, 0, 0, 1, 0, 5), (2, 0, 0, 1, 30, 35)], [], (0, 1, "ADDITION", None, None, 1, 15, True), [(10, 20)]),
        ([(1, 0, 0, 1, 1435, 1445)], [], (0, 1, "DELAY", 1, 10, None, None, True), [(1400, 1455)]),
    ],
)
def test_edits(spark, conn, walk, edit, queries):
    c = spark.createDataFrame([(*x, 0, 0) for x in conn], CONN)
    edited = edits.apply_edits(c, spark.createDataFrame([edit], edits.EDIT_SCHEMA))
    od = spark.createDataFrame([(k, 0, 1, t) for k, (t, _) in enumerate(queries)], OD)
    got = arrivals.earliest(edited, spark.createDataFrame(walk, "u int, v int, w int"), od).orderBy("q_id").collect()
    assert [r.ea for r in got] == [ea for _, ea in queries]


def test_edits_compose_and_stream_equals_batch(spark, tmp_path):
    c = spark.createDataFrame([(1, 0, 0, 1, 0, 5, 0, 0), (2, 0, 0, 1, 10, 15, 0, 0), (3, 0, 0, 1, 20, 25, 0, 0)], CONN)
    rows = [(1, 1, "DELAY", 1, 2, None, None), (2, 2, "DELAY", 1, 3, None, None), (3, 3, "CANCELLATION", 2, None, None, None), (4, 4, "RESTORE", 2, None, None, None), (5, 5, "CANCELLATION", 3, None, None, None)]
    batch = spark.createDataFrame([(0, *r[1:], True) for r in rows], edits.EDIT_SCHEMA)
    want = sorted(tuple(r) for r in edits.apply_edits(c, batch).collect())
    assert want == [(1, 0, 0, 1, 5, 10, 0, 0), (2, 0, 0, 1, 10, 15, 0, 0)]
    log = spark.createDataFrame(rows + rows[:1], "edit_id long, pos int, edit_type string, trip_id int, delta_min int, template_trip_id int, start_minute int").withColumn("ts", F.lit("2025-01-03").cast("timestamp"))
    log.select("edit_id", "ts", "pos", "edit_type", "trip_id", "delta_min", "template_trip_id", "start_minute").write.parquet(str(tmp_path / "in"))
    edit_stream.append_log(edit_stream.read(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    got = edits.apply_edits(c, edit_stream.log_edits(spark, str(tmp_path / "log")))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_collapse_and_queries_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 5, 10, 11, 0), (1, 1, 5, 12, 13, 0), (1, 2, 6, 20, 21, 0)], "trip int, stop_sequence int, stop int, arrival_time int, departure_time int, route_int int")
    assert sorted((r.stop, r.arrival_time, r.departure_time) for r in relational.collapse_same_stop(rows).collect()) == [(5, 10, 13), (6, 20, 21)]
    (tmp_path / "q.csv").write_text("q_id,src,dst\n1,2,3\n")
    with pytest.raises(ValueError):
        timetable.read_queries(spark, str(tmp_path / "q.csv"))
