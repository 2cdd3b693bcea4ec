"""The event graph by chains, from one end and from both, and the one-scan search beyond the bound."""

import random

from test_timetable import CONN, OD, _all

from stopgraph.operators import arrivals, chains, local


def _answers(df):
    return {r.q_id: r.ea for r in df.collect()}


def _city(spark, tmp_path, seed=3):
    rng, rows = random.Random(seed), []
    for trip in range(120):
        t, stop = rng.randint(0, 260), rng.randrange(15)
        for seq in range(rng.randint(1, 6)):
            ride, to = rng.randint(1, 20), rng.randrange(15)
            if to != stop:
                rows.append((trip, seq, stop, to, t, t + ride, 0, 0))
            t, stop = t + ride + rng.randint(0, 3), to
    spark.createDataFrame(rows, CONN).write.parquet(str(tmp_path / "conn"))
    walks = spark.createDataFrame([(u, v, 3 + abs(u - v)) for u in range(15) for v in (u - 2, u - 1, u + 1, u + 2) if 0 <= v < 15], "u int, v int, w int")
    od = spark.createDataFrame([(q, rng.randrange(16), rng.randrange(16), rng.randint(0, 240)) for q in range(40)] + [(40, 1, 2, None), (41, 3, 3, 290)], OD)
    return spark.read.parquet(str(tmp_path / "conn")), walks, od


def test_fixtures(spark):
    conn, walks, od, want = _all(spark)
    conn = conn.cache()
    for both_ways in (False, True):
        assert _answers(chains.earliest(conn, walks, od, both_ways)) == want


def test_chains_and_scan_equal_the_search_on_arrays(spark, tmp_path, monkeypatch):
    """Before, the event graph's edges were all written, and one scan refused a timetable beyond the bound."""
    conn, walks, od = _city(spark, tmp_path)
    exact, scan = _answers(local.earliest(conn, walks, od)), _answers(local.earliest(conn, walks, od, mode="single_pass"))
    assert _answers(chains.earliest(conn, walks, od, True)) == exact
    monkeypatch.setattr(local, "MOST", 10)
    monkeypatch.setattr(chains, "HORIZON", 8)
    assert _answers(chains.one_scan(conn, walks, od)) == scan and arrivals.ready(conn, walks).kept


def test_a_chain_is_entered_once(spark):
    """Departures that a stop's chain was entered before are not entered again."""
    conn = spark.createDataFrame([(k, 0, 0, 1, 10 + k, 15 + k, 0, 0) for k in range(30)] + [(99, 0, 2, 0, 1, 5, 0, 0)], CONN)
    walks = spark.createDataFrame([], "u int, v int, w int")
    seeds = spark.createDataFrame([(1, 0, 20, 60), (1, 2, 0, 60)], "q_id int, stop int, t int, high int")
    waits, rides = chains.reach(chains.event_chains(conn), walks, seeds)
    assert sorted(tuple(r) for r in waits.select("stop", "t").collect()) == [(0, 5), (1, 15), (2, 0)]
    assert sorted(r.trip for r in rides.collect()) == [*range(30), 99]
