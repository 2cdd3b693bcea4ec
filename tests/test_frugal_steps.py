"""Steps that stay small: spells in arrays, one number a pair of nodes, searches that end with their goals."""

import tracemalloc

import pandas as pd

from stopgraph.operators import closure, graphs
from stopgraph.streaming import captures


class _State:
    exists, hasTimedOut = False, False

    def update(self, held):
        self.held = held

    def setTimeoutTimestamp(self, at):
        self.until = at

    def getCurrentWatermarkMs(self):
        return 0


def test_many_spells_of_a_line_take_little_memory():
    at = pd.Timestamp("2025-01-03") + pd.to_timedelta(range(30_000), unit="s")
    rows, state = pd.DataFrame({"captured_at": at, "severity": [k % 2 for k in range(30_000)]}), _State()
    tracemalloc.start()
    got = [len(x) for x in captures._follow(("red",), iter([rows]), state)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(got) == 29_999 and max(got) <= captures.SPELLS and state.held[3] == 1
    assert peak < 8_000_000


def test_least_edge_and_first_type(spark):
    rows = [(1, 2, 3, 4), (1, 2, 3, 0), (1, 3, -5, 2), (1, 3, 4, 0)]
    got = {tuple(r) for r in graphs.least_edges(spark.createDataFrame(rows, "src long, dst long, w int, type int")).collect()}
    assert got == {(1, 2, 3, "BOARD"), (1, 3, -5, "STAY")}


def test_a_search_ends_with_its_goals(spark, monkeypatch):
    chain = spark.createDataFrame([(k, k + 1, 1) for k in range(8)] + [(0, 8, 20)], "u int, v int, w int")
    monkeypatch.setattr(closure, "MANY", 3)
    assert {(r.v, r.d) for r in closure.shortest_paths(chain, spark.createDataFrame([(0,)], "root int")).collect()} == {(k, k) for k in range(9)}
    put, rounds = closure.written, []
    monkeypatch.setattr(closure, "written", lambda df, name: (rounds.append(name), put(df, name))[1])
    pairs = spark.createDataFrame([(0, 2), (5, 5), (3, 1)], "root int, v int")
    assert {tuple(r) for r in closure.reached(chain, pairs.where("root <> 3")).collect()} == {(0, 2), (5, 5)}
    assert rounds.count("best") == 3
    assert {tuple(r) for r in closure.reached(chain, pairs).collect()} == {(0, 2), (5, 5)}
