import hashlib
import random

import numpy as np
import pyarrow as pa

from stopgraph.llm import induced, substrings


def _kept(raw, length=200):
    seen = {}
    for b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for b in raw:
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = True
        out.append((int(mask.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


def _check(spark, texts):
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.report(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = _kept([t.encode() for t in texts])
    assert [got[k] for k in range(len(texts))] == want
    return sum(w[0] for w in want)


def test_control_bytes_count_once(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = []
    for shared in (150, 180, 199, 200, 230):
        for control in ("\x00" * 60, "\x01\x02" * 30, "\x00\x01\x02" * 20):
            passage = word((shared - 60) // 2) + control
            passage += word(shared - len(passage))
            texts += ["A" + word(300) + "<" + passage + ">" + word(300), "B" + word(300) + "[" + passage + "]" + word(300)]
    assert _check(spark, texts) >= 6 * 430


def test_an_anchor_of_more_than_a_shard(monkeypatch, tmp_path):
    rng = random.Random(4)
    word = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    line, near, whole = word(150), word(60), word(260)
    texts = [word(250) + (near if k % 7 == 0 else b"") + line + (near if k % 11 == 0 else b"") + word(250) for k in range(400)]
    texts += [word(220) + whole + word(220) for _ in range(150)]
    rows = {}
    for k, t in enumerate(texts):
        data = np.frombuffer(t, np.uint8)
        for _, h, begin, n, place in zip(*substrings.anchors(data, np.array([0, len(t)]), 200), strict=True):
            region = t[begin : begin + n + 199]
            mark = hashlib.blake2b(region, digest_size=16).digest()
            rows.setdefault((int(h), mark), [int(n), int(place), region, []])[3].append((k, int(begin)))
    whole_rows = [(h, -1, mark, len(at), 0, place, n, region) for (h, mark), (n, place, region, at) in sorted(rows.items())]
    # the same rows dealt to other tasks before
    parts = [(h, side * substrings.FILES + substrings._file(key, 0), mark, times, first, place, cut, body) for h, _, mark, times, _, at, n, region in whole_rows for side, key, first, place, cut, body in substrings._sides(region, 0, at, n, 0, 0, 200)]
    sizes, sort = [], substrings.suffix_order
    monkeypatch.setattr(substrings, "suffix_order", lambda text, cap, *more: sizes.append(len(text)) or sort(text, cap, *more))
    monkeypatch.setattr(induced, "BLOCK", 64)
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 199):
            seen.setdefault(t[i : i + 200], []).append((k, i))
    want = {p for at in seen.values() if len(at) > 1 for p in at}
    for limit in (20_000, 4_000):
        for given in (whole_rows, sorted(parts)):
            got, files = set(), induced.Files(f"file://{tmp_path}/spill")
            # queues of far fewer bytes than a shard's tuples
            for b in substrings._shards(iter([substrings._pieces_batch(given)]), 200, limit, files, 2_000):
                for a, m, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    got |= {(k, begin + x) for k, begin in rows[a, m][3] for x in np.frombuffer(w, np.int32).tolist()}
            assert got == want and max(sizes) < 2.1 * limit
            assert files.written > 10 * limit and not list((tmp_path / "spill").iterdir())
            sizes.clear()


def test_runs_of_nearly_the_length(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts, lengths = [], []
    for shared in (198, 199, 200, 201, 202):
        for byte in ("\x00", "\x01", "\x02", "x"):
            passage = word(90) + byte + word(shared - 91)
            texts += ["A" + word(100) + "<" + passage + ">" + word(100), "B" + word(90) + "[" + passage + "]" + word(95)]
            lengths.append(shared)
    assert _check(spark, texts) == 2 * sum(n for n in lengths if n >= 200)


def test_many_documents_share_a_passage(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD", 30_000)
    monkeypatch.setattr(substrings, "LARGE", 30_000)
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, line = word(400), word(120)
    texts = [word(150) + passage + word(150) for _ in range(60)] + [word(220) + line + word(220) for _ in range(120)] + [word(700) for _ in range(20)]
    assert _check(spark, texts) >= 60 * 400
    assert not spark.sql("show tables").where("tableName like 'stopgraph%'").count()
