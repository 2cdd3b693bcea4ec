"""Route scans and journeys by number of trips, on random timetables with routes of many trips."""

import random

import pytest
from pyspark.sql import functions as F

from stopgraph.operators import arrivals as A
from stopgraph.operators import routes as W

CONN = "trip int, seq int, from_stop int, to_stop int, dep int, arr int"


def _network(rng, stops, lines, trips, overtaking):
    """Rows of connections of ``lines`` with fixed stops; with ``overtaking`` some trips are fast."""
    rows, trip = [], 0
    for _ in range(lines):
        way = rng.sample(range(stops), rng.randint(2, 6))
        hops = [rng.randint(3, 12) for _ in way[1:]]
        for _ in range(trips):
            t, seq = rng.randint(0, 200), rng.choice([0, 1, 3])
            fast = overtaking and rng.random() < 0.3
            for k, hop in enumerate(hops):
                ride = max(1, hop // 3) if fast else hop
                rows.append((trip, seq, way[k], way[k + 1], t, t + ride))
                t, seq = t + ride + rng.randint(0, 2) * overtaking, seq + 1
            trip += 1
    return rows


@pytest.mark.parametrize("overtaking", [False, True])
def test_scan_equals_rounds(spark, overtaking):
    rng = random.Random(8 + overtaking)
    rows = _network(rng, 16, 7, 10, overtaking)
    conn = spark.createDataFrame(rows, CONN)
    walks = spark.createDataFrame([(u, (u + 5) % 16, rng.randint(1, 9)) for u in range(0, 16, 2)], "u int, v int, w int")
    od = spark.createDataFrame([(q, rng.randrange(16), rng.randrange(16), rng.randint(0, 150)) for q in range(30)], "q_id int, src int, dst int, t_dep int")
    net = W.routes(conn)
    want = sorted(A.earliest(conn, walks, od).collect())
    assert sorted(A.earliest(net, walks, od).collect()) == want
    journeys = W.journeys(net, walks, od)
    bounds = spark.createDataFrame([(2,), (None,)], "max_trips int")
    lanes = W.within(journeys, od, bounds).collect()
    for k in (2, None):
        expected = want if k is None else sorted(A.earliest(conn, walks, od, max_boardings=k).collect())
        assert sorted(tuple(r)[1:] for r in lanes if r.max_trips == k) == [tuple(r) for r in expected]
    # journeys of one query: more trips, and earlier each time
    by_query = {}
    for r in sorted(journeys.collect()):
        by_query.setdefault(r.q_id, []).append(r.ea)
    assert all(a > b for eas in by_query.values() for a, b in zip(eas, eas[1:], strict=False))


def test_chains(spark, monkeypatch):
    """Trips of one pattern are one chain until one overtakes; a trip of other stops is another."""
    trips = {0: [(0, 5), (6, 9)], 1: [(10, 15), (16, 19)], 2: [(12, 14), (15, 18)], 3: [(20, 25), (26, 29)], 4: [(20, 25), (26, 29)]}
    rows = [(t, s, s, s + 1, *times[s]) for t, times in trips.items() for s in (0, 1)] + [(9, 0, 0, 2, 0, 5)]
    got = {r.trip: (r.chain, r["rank"]) for r in W.chains(spark.createDataFrame(rows, CONN)).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (2, 0), 3: (2, 1), 4: (2, 2), 9: (9, 0)}
    monkeypatch.setattr(W, "CHAIN", 2)
    got = {r.trip: (r.chain, r["rank"]) for r in W.chains(spark.createDataFrame(rows, CONN)).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (2, 0), 3: (2, 1), 4: (4, 0), 9: (9, 0)}


def test_one_trip_a_chain_is_ridden(spark):
    """Forty trips of a route, all catchable: one boarding, not forty."""
    rows = [(t, s, s, s + 1, t * 5 + s * 4, t * 5 + s * 4 + 3) for t in range(40) for s in range(5)]
    net = W.routes(spark.createDataFrame(rows, CONN))
    front = spark.createDataFrame([(0, 0, 12), (0, 3, 15), (0, 2, 200)], "q_id int, stop int, t int")
    at = front.join(net.leaving, "stop")
    assert at.count() == 3 and net.leaving.agg(F.max(F.size("deps"))).first()[0] == 40
    got = {r.stop: r.t for r in net.ride(front, 0).collect()}
    # from stop 0 at 12 the trip at 15; at stop 3 trip 1 (17) is earlier than that one (27); the late label adds nothing
    assert got == {1: 18, 2: 22, 3: 26, 4: 20, 5: 24}


def test_empty(spark):
    none = spark.createDataFrame([], CONN)
    walks = spark.createDataFrame([(1, 2, 4)], "u int, v int, w int")
    od = spark.createDataFrame([(0, 1, 2, 10), (1, 2, 1, 10), (2, 3, 3, 7)], "q_id int, src int, dst int, t_dep int")
    net = W.routes(none)
    assert sorted(tuple(r) for r in W.journeys(net, walks, od).collect()) == [(0, 0, 14), (2, 0, 7)]
    assert {r.q_id: r.ea for r in A.earliest(net, walks, od).collect()} == {0: 14, 1: None, 2: 7}
