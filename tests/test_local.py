"""Searches on tables held by tasks against rounds of relations; modes, bounds and switches."""

import random

import pytest
from test_timetable import CONN, FIXTURES, OD, _all

from stopgraph.operators import arrivals, graphs, local, relational
from stopgraph.operators.closure import shortest_paths, walk_closure


def _answers(df):
    return {r.q_id: r.ea for r in df.collect()}


def test_fixtures_on_every_path(spark):
    conn, walks, od, want = _all(spark)
    conn, walks, od = conn.cache(), walks.cache(), od.cache()
    assert _answers(local.earliest(conn, walks, od)) == want
    assert _answers(arrivals.answer(conn, walks, od)) == want
    assert _answers(arrivals.earliest(arrivals.network(conn), walks, od)) == want
    edges = graphs.event_edges(conn, walks)
    assert _answers(graphs.earliest_on_events(conn, walks, od, edges, both_ways=True)) == want
    # landmarks on the first stops of some fixtures
    labels = graphs.landmark_labels(graphs.lower_bound_graph(conn, walks), spark.createDataFrame([(100 * k,) for k in range(0, 20, 3)], "root int"))
    assert _answers(arrivals.earliest(conn, walks, od, bounds=graphs.front_bounds(labels))) == want
    few = graphs.active_landmarks(labels, od, 2)
    assert _answers(arrivals.earliest(conn, walks, od, bounds=graphs.front_bounds(labels, few))) == want
    # one scan misses the walk after a ride of N1 only
    n1 = sum(len(q) for c, w, q in list(FIXTURES.values())[: list(FIXTURES).index("N1")])
    assert _answers(local.earliest(conn, walks, od, mode="single_pass")) == {**want, n1: None}
    # the stop graph's reach is a gate that shuts nobody out
    near = shortest_paths(graphs.lower_bound_graph(conn, walks), od.selectExpr("src as root").distinct())
    open_ = od.join(near, (od.src == near.root) & (od.dst == near.v), "left_semi")
    assert {q for q, ea in want.items() if ea is not None} <= {r.q_id for r in open_.collect()}


def test_latest_departures_have_the_right_minutes(spark):
    conn, walks, od, want = _all(spark)
    back = od.selectExpr("q_id", "src", "dst", "60 as deadline")
    rounds = {r.q_id: r.ld for r in arrivals.latest(conn, walks, back).collect()}
    assert rounds == {r.q_id: r.ld for r in arrivals.latest(conn, walks, back, switch=True).collect()}
    # leaving then still arrives in time, and leaving a minute later does not
    for more, fits in ((0, True), (1, False)):
        rows = [(r.q_id, r.src, r.dst, rounds[r.q_id] + more) for r in od.collect() if rounds[r.q_id] is not None]
        for q, ea in _answers(local.earliest(conn, walks, spark.createDataFrame(rows, OD))).items():
            assert (ea is not None and ea <= 60) == fits, q
    assert sum(v is None for v in rounds.values()) == 3


def test_bounds_of_trips(spark):
    rows = [(0, 0, 0, 1, 5, 10, 0, 0), (1, 0, 1, 2, 12, 20, 0, 0)]
    rows += [(2, k, 5 + k, 6 + k, 10 * k, 10 * k + 5, 0, 0) for k in range(5)]
    conn, walks = spark.createDataFrame(rows, CONN), spark.createDataFrame([], "u int, v int, w int")
    od = spark.createDataFrame([(0, 0, 2, 0), (1, 5, 10, 0)], OD)
    for k, want in ((1, {0: None, 1: 45}), (2, {0: 20, 1: 45}), (None, {0: 20, 1: 45})):
        assert _answers(local.earliest(conn, walks, od, k)) == want == _answers(arrivals.earliest(conn, walks, od, k))


def test_overtaking_walks_and_nights(spark):
    # N7: the later, faster trip of a route is taken; N2: no walk beyond the cap; N10 a delayed trip is N7's first
    conn = spark.createDataFrame([(0, 0, 0, 1, 5, 40, 0, 0), (1, 0, 0, 1, 10, 20, 0, 0), (2, 0, 3, 4, 1430, 1450, 1, 0)], CONN)
    walks = walk_closure(spark.createDataFrame([(1, 5, 9), (5, 6, 9), (1, 7, 8), (7, 8, 7)], "u int, v int, w int"), 15)
    od = spark.createDataFrame([(0, 0, 1, 0), (1, 0, 5, 0), (2, 0, 6, 0), (3, 0, 8, 0), (4, 3, 4, 1400)], OD)
    assert _answers(local.earliest(conn, walks, od)) == {0: 20, 1: 29, 2: None, 3: 35, 4: 1450}
    assert _answers(arrivals.on_grid(conn, walks, spark.createDataFrame([(0, 0, 1, 0), (1, 0, 1, -1), (2, 3, 4, 1400)], OD), 0, 780)) == {0: 20, 1: None, 2: None}


def test_larger_timetables_go_by_rounds(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for trip in range(60):
        t = rng.randint(0, 200)
        stops = rng.sample(range(12), 5)
        for seq, (a, b) in enumerate(zip(stops, stops[1:], strict=False)):
            rows.append((trip, seq, a, b, t, t + rng.randint(1, 9), trip % 4, 0))
            t = rows[-1][5] + rng.randint(0, 3)
    conn = spark.createDataFrame(rows, CONN)
    walks = walk_closure(spark.createDataFrame([(0, 1, 4), (1, 0, 4), (1, 2, 5)], "u int, v int, w int"), 15)
    od = spark.createDataFrame([(k, rng.randint(0, 11), rng.randint(0, 11), rng.randint(0, 150)) for k in range(40)], OD)
    held = _answers(arrivals.answer(conn, walks, od))
    monkeypatch.setattr(local, "MOST", 10)
    assert not local.fits(conn, walks) and _answers(arrivals.answer(conn, walks, od)) == held
    reached = {(r.q_id, r.stop): r.t for r in arrivals.labels(conn, walks, od, prune=False).collect()}
    assert reached == {(r.q_id, r.stop): r.t for r in local.one_to_all(conn, walks, od).collect()}


def test_links_of_one_busy_stop(spark):
    rng = random.Random(8)
    rows = [(k, 0, 1, 2, rng.choice([5, 100, 100, 101, 700]), 705, 0, 0) for k in range(300)] + [(1000 + k, 0, 3, 1, 0, rng.randint(0, 720), 0, 0) for k in range(200)]
    conn = spark.createDataFrame(rows, CONN)
    leave = sorted((r[4], r[0]) for r in rows if r[2] == 1)
    got = {r.trip: (r.ntrip, r.w) for r in relational.wait_edges(conn).where("trip < 1000").collect()}
    assert got == {a[1]: (b[1], b[0] - a[0]) for a, b in zip(leave, leave[1:], strict=False)}
    first = {r.trip: (r.bdep, r.btrip) for r in relational.board_asof(relational.arrival_events(conn), conn, ["trip", "seq"]).where("stop = 1").collect()}
    want = {r[0]: next((d for d in leave if d[0] >= r[5]), None) for r in rows if r[3] == 1}
    assert first == {k: v for k, v in want.items() if v}
    place = {r.trip: r.pos for r in relational.stop_event_index(conn).where("stop = 1").collect()}
    assert place == {trip: k for k, (_, trip) in enumerate(leave)}


def test_unknown_modes_are_refused(spark):
    conn, walks, od, _ = _all(spark)
    with pytest.raises(ValueError):
        local.earliest(conn, walks, od, mode="other")
