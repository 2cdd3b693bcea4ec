"""Rows before each other in groups that are dealt by slots, against sorted lists."""

import math
import random

from stopgraph.operators import edits, relational

ST = "route_int int, seq int, trip int, stop int, arr int, dep int, mode int"


def test_previous_row_of_busy_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), k, rng.choice([None, rng.randint(-40, 700), 0, 15]), rng.randint(0, 9)) for k in range(1500)]
    rows += [(1, 10_000 + k, None, k % 5) for k in range(300)]  # minutes missing over more than one slot of ties
    got = relational.with_previous(spark.createDataFrame(rows, "g int, trip int, t int, x int"), ["g"], "t", "trip", ["trip", "x"]).collect()
    want, last = {}, {}
    for g, trip, t, x in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[1])):
        want[trip] = last.get(g)
        last[g] = (trip, x)
    assert len(got) == len(rows) and {r.trip: tuple(r.near) if r.near else None for r in got} == want


def test_inversions_of_one_busy_route(spark):
    rng = random.Random(2)
    rows = []
    for trip in range(400):
        t = rng.randint(0, 600)
        for seq in range(3):
            dep = None if rng.random() < 0.1 else t
            rows.append((7, seq, trip, seq, t - 1, dep, 0))
            t += rng.randint(1, 40)
    table = spark.createDataFrame(rows, ST)
    start = {}
    for r in sorted(rows, key=lambda r: -r[1]):
        if r[5] is not None:
            start[r[2]] = min(start.get(r[2], 10**6), r[5])
    want = set()
    for seq in range(3):
        here = sorted((r for r in rows if r[1] == seq), key=lambda r: (start.get(r[2], 10**6), r[2]))
        want |= {(seq, a[2], b[2]) for a, b in zip(here, here[1:], strict=False) if a[4] > b[4]}
    assert {(r.seq, r.earlier, r.trip) for r in relational.fifo_adjacent(table).collect()} == want
    n = 0
    for x in range(3):
        for y in range(x + 1, 3):
            at = {r[2]: r for r in rows if r[1] == y}
            here = sorted((r[5], r[2]) for r in rows if r[1] == x and r[5] is not None)
            n += sum(at[a[1]][4] > at[b[1]][4] for a, b in zip(here, here[1:], strict=False))
    assert sum(r.n_inversions for r in relational.fifo_pairs(table).collect()) == n > 0


def test_additions_lie_in_free_windows(spark):
    rng = random.Random(3)
    starts = {(route, 100 * route + k): rng.randint(0, 780) for route in range(1, 9) for k in range(1 + 3 * route)}
    rows = [(trip, 0, 1, 2, t, t + 9, route, 0) for (route, trip), t in starts.items()]
    conn = spark.createDataFrame(rows, "trip int, seq int, from_stop int, to_stop int, dep int, arr int, route_int int, mode int")
    got = {r.template_trip_id: r.start_minute for r in edits.additions(conn, 100, 5).collect()}
    assert len(got) == len({t // 100 for t in got}) > 0 and all(math.isfinite(m) for m in got.values())
    for trip, minute in got.items():
        others = sorted(t for (route, _), t in starts.items() if route == trip // 100)
        assert all(abs(minute - t) >= 5 for t in others) and 5 <= minute <= 775
    assert edits.additions(conn.where("false"), 5, 1).count() == 0


def test_added_trips_of_equal_places_are_numbered_by_template_and_start(spark):
    conn = spark.createDataFrame([(k, 0, 1, 2, 10 * k, 10 * k + 5, 1, 0) for k in (1, 2, 3)], "trip int, seq int, from_stop int, to_stop int, dep int, arr int, route_int int, mode int")
    added = [(0, 7, "ADDITION", None, None, 2, 300, True), (0, 7, "ADDITION", None, None, 1, 200, True), (0, 7, "ADDITION", None, None, 1, 100, True)]
    got = edits.apply_edits(conn, spark.createDataFrame(added, edits.EDIT_SCHEMA)).where("trip > 3").orderBy("trip")
    assert [(r.trip, r.dep) for r in got.collect()] == [(4, 100), (5, 200), (6, 300)]
