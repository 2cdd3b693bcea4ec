"""Contraction by rounds: distances over up and down edges equal those of the graph itself."""

import random

import pytest

from stopgraph.operators import hierarchies
from stopgraph.operators.closure import shortest_paths

GRAPH = "u int, v int, w int"


def _check(spark, rows, pairs, limit=hierarchies.PAIRS):
    graph = spark.createDataFrame(rows, GRAPH)
    levels, edges = hierarchies.contract(graph, limit)
    asked = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "q_id int, src int, dst int")
    true = {(r.root, r.v): r.d for r in shortest_paths(graph, asked.selectExpr("src as root").distinct()).collect()}
    got = hierarchies.distances(levels, edges, asked).collect()
    assert len(got) == len(pairs) and all(r.d == true.get((r.src, r.dst)) for r in got)
    assert {r.stop for r in levels.collect()} == {s for u, v, _ in rows for s in (u, v)} and levels.count() == levels.select("stop").distinct().count()
    return {r.stop: r.level for r in levels.collect()}, edges


@pytest.mark.parametrize("limit", [64, 6])
def test_random_graph(spark, limit):
    """With few pairs allowed a core stays; its edges are crossed too."""
    rng = random.Random(4)
    rows = [(u, v, rng.randint(1, 20)) for u in range(20) for v in rng.sample(range(20), 3)] + [(40, 41, 3), (7, 7, 1), (0, 1, 9), (0, 1, 2)]
    pairs = [(rng.randint(0, 19), rng.randint(0, 19)) for _ in range(60)] + [(0, 41), (40, 41), (41, 40), (40, 40)]
    levels, edges = _check(spark, rows, pairs, limit)
    top = [s for s, level in levels.items() if level == max(levels.values())]
    assert (len(top) > 3) == (limit == 6)
    if limit == 64:
        assert edges.count() > len({(u, v) for u, v, _ in rows if u != v})


def test_neighbours_never_share_a_round(spark):
    """A ladder of streets: all is contracted, a round at a time, without neighbours in one."""
    rows = [(6 * x + y, 6 * a + b, 1 + (x * y) % 3) for x in range(6) for y in range(6) for a, b in ((x + 1, y), (x, y + 1), (x - 1, y), (x, y - 1)) if 0 <= a < 6 and 0 <= b < 6]
    levels, edges = _check(spark, rows, [(u, (u * 7 + 5) % 36) for u in range(36)])
    top = max(levels.values())
    assert 4 <= top <= 20
    assert all(levels[r.u] != levels[r.v] or levels[r.u] == top for r in edges.collect())


def test_empty_graph(spark):
    levels, edges = hierarchies.contract(spark.createDataFrame([], GRAPH))
    assert levels.count() == edges.count() == 0
