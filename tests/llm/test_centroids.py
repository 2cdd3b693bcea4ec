"""Clustering on distinct vectors against a brute-force version over all rows."""

import hashlib
import math

from stopgraph.llm import centroids

NAN, INF = float("nan"), float("inf")


def _brute(rows, k, rounds, dim, scale=64, seed=1):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, own, strict=True)), j) for j, own in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    done = [(i, *nearest(v)) for i, v in kept]
    most = (1 << 63) - 1
    own = {j: sum(d for _, d, a in done if a == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return [(i, j, min(d, most), min(own[j], most), min(sum(own.values()), most), sha[j]) for i, d, j in done]


def _check(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, copies string")
    got = centroids.cluster(spark, df, **kw).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(_brute(rows, kw["k"], kw["rounds"], kw["dim"]), key=key)
    return got


def test_odd_vectors(spark):
    rows = [(k, [((k * 37 + j * 11) % 29 - 14) / 16 for j in range(4)]) for k in range(200)]
    rows += [(1000 + k, [0.5, -0.25, 0.125, 0.0]) for k in range(150)]  # a vector that many ids share
    rows += [(5, [0.1, 0.2, 0.3, 0.4]), (5, [0.1, 0.2, 0.3, 0.4]), (None, [0.1, 0.2, 0.3, 0.4]), (None, None), (300, []), (301, [1.0, 2.0, 3.0]), (302, [1.0, None, 3.0, 4.0]), (303, [1.0, NAN, 3.0, 4.0]), (304, [INF, 1.0, 1.0, 1.0]), (305, [-INF, 1.0, 1.0, 1.0])]
    got = _check(spark, rows, k=16, rounds=3, dim=4)
    assert len(got) == 353


def test_ties_and_empty_clusters(spark):
    """Equal vectors as seeds: the larger number of equal centroids stays empty and as it was."""
    _check(spark, [(k, [1.0, 1.0]) for k in range(40)] + [(k, [-1.0, 0.5]) for k in range(40, 44)], k=8, rounds=3, dim=2)


def test_few_vectors(spark):
    _check(spark, [(k, [float(k), -float(k)]) for k in range(3)], k=16, rounds=2, dim=2)
    _check(spark, [(1, None), (2, [1.0])], k=16, rounds=2, dim=2)
    _check(spark, [], k=16, rounds=2, dim=2)


def test_large_components(spark):
    """Beyond what doubles hold exactly, and beyond longs in the sums."""
    rows = [(k, [float((k * 7919) % 1000) * 2.0**30, -float(k % 13) * 2.0**33]) for k in range(60)]
    _check(spark, rows, k=5, rounds=3, dim=2)


def test_hashes_that_do_not_tell_vectors_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(centroids, "_hashes", lambda q="q": [(F.xxhash64(q) * 0).alias("h1"), (F.xxhash64(q) * 0).alias("h2")])
    _check(spark, [(k, [k % 7 / 4, k % 5 / 8]) for k in range(50)], k=4, rounds=2, dim=2)
