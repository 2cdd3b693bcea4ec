"""Metrics of the event graph, counted, against those of its edges."""

import random

from stopgraph.operators import graphs, reports

CONN = "trip int, seq int, from_stop int, to_stop int, dep int, arr int, route_int int, mode int"


def test_counts_equal_edges(spark, monkeypatch):
    """Before, all edges were made and grouped; stays that are boardings or walks too, gaps, equal minutes, waits of a slot and more, trips that go back."""
    rng, rows = random.Random(9), []
    for trip in range(50):
        t, stop = rng.randint(0, 150), rng.randrange(9)
        for seq in range(4):
            to = rng.randrange(9)
            rows.append((trip, 2 * seq, stop, to, t, t + rng.choice([0, 3, 8]), 0, 0))
            t, stop = rows[-1][5] + rng.choice([-1, 0, 0, 1, 4, 7]), to if rng.random() < 0.7 else rng.randrange(9)
    walks = spark.createDataFrame([(k, (k + d) % 10, 4) for k in range(9) for d in (1, 2)], "u int, v int, w int")
    for some in (rows, []):
        conn = spark.createDataFrame(some, CONN)
        want = reports.graph_metrics(graphs.event_edges(conn, walks)).first()
        monkeypatch.setattr(graphs, "event_edges", None)
        got = graphs.event_metrics(conn, walks)
        assert got.columns == ["n_nodes", "n_edges", "most_out"] and got.first() == want
        monkeypatch.undo()
