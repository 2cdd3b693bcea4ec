"""Steps of the sort that go by arrays: common prefixes from the ranks of doubling, runs of many rows at once."""

import numpy as np
import pyarrow as pa

from stopgraph.llm import induced, substrings


def test_prefixes_come_from_ranks(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [np.r_[rng.integers(1, k + 1, n), 0].astype(np.int32) for k in (1, 2, 5, 400) for n in (1, 2, 37, 700)]
    texts.append(np.r_[np.tile(rng.integers(1, 9, 90), 4), 0].astype(np.int32))
    want = []
    for text in texts:
        for cap in (1, 3, 64, 102):
            order, shared = induced._doubled(text, cap)
            assert sorted(order.tolist()) == list(range(len(text)))
            heads = [tuple(text[i : i + cap].tolist()) for i in order]
            assert heads == sorted(heads)
            want = [0] + [next((k for k, (x, y) in enumerate(zip(p, q, strict=False)) if x != y), min(len(p), len(q))) for p, q in zip(heads, heads[1:], strict=False)]
            assert shared.tolist() == want
    # names are not compared one by one
    monkeypatch.setattr(induced, "shared_prefix", None)
    induced._doubled(texts[-1], 102)


def test_runs_of_rows_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(substrings, "CHUNK", 3000)
    rows = []
    for _ in range(200):
        rows.append([{"begin": int(rng.integers(0, 2000)), "windows": [np.unique(rng.integers(0, 150, rng.integers(1, 30))).astype(np.int32).tobytes() for _ in range(rng.integers(1, 4))]} for _ in range(rng.integers(1, 9))])
    column = pa.array(rows, pa.list_(pa.struct([("begin", pa.int32()), ("windows", pa.list_(pa.binary()))])))
    got = [(k + i, r) for i, runs in substrings._joined(column.slice(7), 50) for k, r in enumerate(runs.to_pylist())]
    assert [i for i, _ in got] == list(range(193))
    for i, runs in got:
        covered = sorted({x + h["begin"] + d for h in rows[i + 7] for w in h["windows"] for x in np.frombuffer(w, np.int32).tolist() for d in range(50)})
        assert [x for r in runs for x in range(r["begin"], r["end"])] == covered
        assert all(y["begin"] > x["end"] for x, y in zip(runs, runs[1:], strict=False))
