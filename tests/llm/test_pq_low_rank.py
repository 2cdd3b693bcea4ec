import numpy as np
import pytest

from stopgraph.llm import pq


def _links(x):
    """Which rows of unit vectors link, and the smallest row that each one reaches."""
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(link, label[None], len(x)).min(1))
        if (new == label).all():
            return link, label
        label = new


@pytest.mark.parametrize("rank", [2, 3, 8, 64])
def test_links_of_low_rank_vectors(spark, monkeypatch, rank):
    monkeypatch.setattr(pq, "OF_CELL", 300)  # and an index, whatever the size
    monkeypatch.setattr(pq, "BLOCK", 256)
    rng = np.random.default_rng(rank)
    # all vectors in a few of 64 dimensions: differences lie along few directions
    x = rng.normal(size=(2500, rank)) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T
    x /= np.sqrt((x**2).sum(1))[:, None]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in pq.near_duplicates(spark, table).collect()}
    link, label = _links(x)
    assert [got[k].n_links for k in range(len(x))] == link.sum(1).tolist()
    assert [got[k].component_id for k in range(len(x))] == label.tolist()


def test_vectors_of_a_hundred_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=1 + k % 100).tolist()) for k in range(300)]
    got = {r.vec_id: r.n_links for r in pq.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    want = [sum(i != k and len(u) == len(w) and u @ w >= 0.95 for i, w in enumerate(unit)) for k, u in enumerate(unit)]
    assert [got[k] for k in range(300)] == want and sum(want)


@pytest.mark.parametrize(("n", "rank"), [(300, 2), (300, 64), (2000, 3), (6000, 8), (6000, 64)])
def test_the_index_as_it_is_at_every_size(spark, n, rank):
    rng = np.random.default_rng(n + rank)
    x = rng.normal(size=(n, rank)) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, 64)) * 0.15 * rng.random((n - n // 2, 1)) * np.sqrt((x[: n - n // 2] ** 2).mean(1))[:, None]
    x /= np.sqrt((x**2).sum(1))[:, None]
    # ids that stand twice are rows like others, here equal ones
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(0, x[0].tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in pq.near_duplicates(spark, table).collect()}
    link, label = _links(x)
    want = link.sum(1) + link[0]
    want[0] += 1
    assert [got[k].n_links for k in range(n)] == want.tolist() and link.sum()
    assert [got[k].component_id for k in range(n)] == label.tolist()


def test_looked_up_distances_are_those_of_decoded_vectors():
    rng = np.random.default_rng(1)
    x = pq._unit(rng.normal(size=(900, 20)))
    index = pq.Index.fitted(x, len(x), 0)
    own, codes, off, size = index.coded(x)
    known = index.coarse[own]
    for k, book in enumerate(index.books):
        known[:, index.cuts[k] : index.cuts[k + 1]] += book[codes[:, k]]
    assert np.allclose(off, np.sqrt(((x - known) ** 2).sum(1))) and np.allclose(size, (known**2).sum(1))
    far = ((x[:, None] - known[None]) ** 2).sum(2)
    i, j = index.candidates(x, own, codes, (1.2 - size - 1).astype(np.float32))
    got = np.zeros(far.shape, bool)
    got[i, j] = True
    assert got[far < 1.2 - 1e-4].all() and not got[far > 1.2 + 1e-4].any()
