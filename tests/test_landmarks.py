"""Several landmark selections as worlds of one search, against shortest paths in NumPy."""

import hashlib

import numpy as np
import pytest

from stopgraph.operators import graphs, local
from stopgraph.operators.arrivals import answer, earliest

FAR = 10**6


def _draw(seed, *parts):
    return int(hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16) / 2**32


def _distances(edges, n):
    d = np.full((n, n), FAR)
    np.fill_diagonal(d, 0)
    for u, v, w in edges:
        d[u, v] = min(d[u, v], w)
    for k in range(n):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    return d


def _select(d, first, k):
    chosen = [first]
    while len(chosen) < k:
        near = d[chosen].min(0)
        rest = [v for v in range(len(d)) if v not in chosen and near[v] < FAR]
        if not rest:
            break
        chosen.append(min(rest, key=lambda v: (-near[v], v)))
    return chosen


@pytest.fixture(scope="module")
def edges():
    rng = np.random.default_rng(5)
    out = [(int(rng.integers(40)), int(rng.integers(40)), int(rng.integers(1, 30))) for _ in range(110)]
    return [(u, v, w) for u, v, w in out if u != v] + [(40, 41, 3), (41, 40, 4)]  # and two stops apart from the others


def test_restarts(spark, edges):
    graph = spark.createDataFrame(edges, "u int, v int, w int").groupBy("u", "v").agg({"w": "min"}).withColumnRenamed("min(w)", "w")
    d = _distances(edges, 42)
    stops = {u for u, _, _ in edges}
    starts = sorted(stops, key=lambda s: (_draw(4, s), s))[:4]
    want = [_select(d, s, 5) for s in starts]
    pairs = []
    for s in sorted(stops, key=lambda s: (_draw(3, s), s))[:7]:
        reached = [v for v in range(42) if 0 < d[s, v] < FAR]
        pairs += [(s, v) for v in sorted(reached, key=lambda v: (_draw(3, s, v), v))[:6]]

    def bound(lms, s, t):
        best = 0
        for x in lms:
            if d[s, x] < FAR and d[t, x] < FAR:
                best = max(best, d[s, x] - d[t, x])
            if d[x, t] < FAR and d[x, s] < FAR:
                best = max(best, d[x, t] - d[x, s])
        return best

    quality = [sum(int(bound(lms, s, t)) * 10**6 // int(d[s, t]) for s, t in pairs) / (len(pairs) * 10**6) for lms in want]
    got = graphs.landmark_restarts(graph, 5, 4, 7, 6, 3).collect()
    best = max(range(4), key=lambda k: (quality[k], -k))
    assert sorted((r.world, r.pos, r.stop, r.n_pairs, r.quality, r.best) for r in got) == [(k, p, s, len(pairs), quality[k], k == best) for k, lms in enumerate(want) for p, s in enumerate(lms)]


def test_worlds_from_one_stop_and_from_stops_apart(spark, edges):
    graph = spark.createDataFrame(edges, "u int, v int, w int")
    d = _distances(edges, 42)
    first = edges[0][0]
    starts = spark.createDataFrame([(0, first), (1, first), (2, 40)], "world int, stop int")
    got = sorted(tuple(r) for r in graphs.landmark_worlds(graph, starts, 4).collect())
    assert got == [(k, p, s) for k, f in enumerate((first, first, 40)) for p, s in enumerate(_select(d, f, 4))]
    assert [r[2] for r in got if r[0] == 2] == [40, 41]


def test_no_graph(spark):
    graph = spark.createDataFrame([], "u int, v int, w int")
    assert graphs.landmark_restarts(graph, 3, 2, 2, 2, 1).count() == 0


def test_timetables_beyond_the_bound(spark, monkeypatch):
    conn = spark.createDataFrame([(1, 0, 1, 2, 10, 20), (2, 0, 2, 3, 25, 30)], "trip int, seq int, from_stop int, to_stop int, dep int, arr int")
    walks = spark.createDataFrame([], "u int, v int, w int")
    od = spark.createDataFrame([(1, 1, 3, 5)], "q_id int, src int, dst int, t_dep int")
    held = local.hold(conn, walks)
    assert [answer(conn, walks, od, k, held).first().ea for k in (None, 1)] == [30, None]
    monkeypatch.setattr(local, "MOST", 1)
    assert local.hold(conn, walks) is None
    with pytest.raises(ValueError, match="by rounds"):
        local.earliest(conn, walks, od, mode="single_pass")
    assert answer(conn, walks, od).first().ea == earliest(conn, walks, od).first().ea == 30
