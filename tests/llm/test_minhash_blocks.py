"""The block step alone, and rows that share an id, against brute force."""

import random

from stopgraph.llm import minhash


def _sets(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def _groups(sets):
    """The smallest id that each row reaches by links."""
    label = list(range(len(sets)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, (_, s) in enumerate(sets):
        for j, (_, r) in enumerate(sets):
            if 100 * len(s & r) >= 75 * len(s | r):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    low = {}
    for k, (i, _) in enumerate(sets):
        low[top(k)] = min(i, low.get(top(k), i))
    return [low[top(k)] for k in range(len(sets))]


def test_blocks(spark, monkeypatch):
    # star rounds off and tiny blocks: the block step alone must find every group
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    monkeypatch.setattr(minhash, "TRIED", 3)
    rng = random.Random(5)
    rows = []
    for _ in range(6):
        base = [str(rng.randint(0, 9999)) for _ in range(60)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randint(0, 59)] = str(rng.randint(10000, 99999))
            rows.append((len(rows) * 7 % 151, " ".join(w)))
    rows = list(dict(rows).items())
    got = {tuple(r) for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash").collect()}
    sets = [(i, _sets(t)) for i, t in rows]
    want = _groups(sets)
    assert got == {(i, len(s), low, low == i) for (i, s), low in zip(sets, want, strict=True)}
    assert len(set(want)) < len(sets) / 3


def test_one_id_with_several_texts(spark):
    rng = random.Random(6)
    text = lambda: [str(rng.randint(0, 9999)) for _ in range(60)]
    a, b, c = text(), text(), text()
    near = lambda w: " ".join([*w[:30], "changed", *w[31:]])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (9, near(a)), (8, near(b)), (8, " ".join(c)), (3, near(c)), (7, " ".join(a))]
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash").collect())
    sets = [(i, _sets(t)) for i, t in rows]
    assert got == sorted((i, len(s), low, low == i) for (i, s), low in zip(sets, _groups(sets), strict=True))
    assert {r[2] for r in got} == {3, 7}
