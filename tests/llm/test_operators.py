"""Small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stopgraph.llm import bpe, components, induced, licenses, minhash, mixing, pq, quality, substrings, topk, toxicity, warc
from stopgraph.llm.common import Scratch

BPE = public_tokenizers.path("byte_bpe_50k.json")


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    base = [_words(rng, n) for n in (80, 120, 60, 200)]
    near = base[1].split()
    near[60] = "changed"
    passage = _words(rng, 60)
    out = [(k, t) for k, t in enumerate(base)]
    out += [(10, base[0]), (11, " ".join(near)), (12, base[0].upper()), (20, None), (21, ""), (22, " \n\t"), (23, "one two"), (24, "ONE  two"), (None, base[2]), (3, base[3])]
    out += [(30, _words(rng, 50) + " " + passage + " " + _words(rng, 40)), (31, _words(rng, 20) + " " + passage), (32, "é\x00\x01\x02 " + passage + " über"), (33, "la " * 3000), (34, _words(rng, 20_000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1.0, 2.0) for i, t in texts], "doc_id long, text string, rest string, score double, mix_epoch double")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def _set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_minhash(spark, docs, empty, texts):
    got = minhash.near_duplicates(spark, docs).drop("text_hash").collect()
    assert len(got) == len(texts)
    sets = [(i, _set(t)) for i, t in texts]
    parent = {i: i for i, _ in sets if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets:
        for j, r in sets:
            if i is not None and j is not None and s and 100 * len(s & r) >= 75 * len(s | r):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    want = {(i, len(s), top(i), top(i) == i) for i, s in sets if i is not None}
    assert {tuple(r) for r in got if r.doc_id is not None} == want
    (null,) = [r for r in got if r.doc_id is None]
    assert null.component_id == 2 and not null.kept
    assert minhash.near_duplicates(spark, empty).count() == 0


def test_registers_agree_as_often_as_sets_do():
    rng = np.random.default_rng(4)
    hits = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 40).astype(np.uint64)
        y = np.concatenate([x[:30], rng.integers(0, 1 << 63, 10).astype(np.uint64)])
        r = minhash.registers(np.concatenate([x, y]), np.array([40, 40]))
        hits.append(minhash.estimate(int((r[0] == r[1]).sum())))
    assert abs(np.mean(hits) - 0.6) < 0.03


def test_components(spark):
    rng = random.Random(1)
    edges = [(a, a + 1) for a in range(0, 40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(45)] + [(500, k) for k in range(501, 560)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


def _kept(texts, length=200):
    raw = [(t or "").encode() for _, t in texts]
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
        spans = int((mask & ~np.r_[False, mask[:-1]]).sum()) if len(b) else 0
        out.append((len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


def test_substrings(spark, docs, empty, texts):
    got = substrings.report(spark, docs)
    want = sorted((str(i), *w) for (i, _), w in zip(texts, _kept(texts), strict=True))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert substrings.report(spark, empty).count() == 0
    cut = {r.doc_id: r.text for r in substrings.removed(spark, docs).collect()}
    assert cut[0] == "" and cut[23] == "one two" and cut[20] is None


def test_suffix_order_is_exact():
    rng = random.Random(3)
    for k in range(150):
        n, sigma = rng.randint(1, 60), rng.choice([1, 2, 3, 26])
        s = bytes(rng.randint(1, sigma) for _ in range(n))
        s = s if k % 3 else (s[: max(1, n // 5)] * 7)[:200]
        order, shared = induced.suffix_order(np.frombuffer(s, np.uint8), 200, budget=rng.choice([1, 1 << 20]))
        want = sorted(range(len(s)), key=lambda i: s[i:])
        lcp = [0] + [next((x for x in range(200) if s[a + x : a + x + 1] != s[b + x : b + x + 1] or a + x >= len(s)), 200) for a, b in zip(want, want[1:], strict=False)]
        assert order.tolist() == want and shared.tolist() == lcp


def test_bpe_equals_library(spark, docs, empty, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    rng = random.Random(6)
    parts = ["a", " ", "\n", "é", "日本", "'s", "!", "<|endoftext|>", "<|endo", "😀", "123", "hahaha", "\t", "\x85", "　", "Z"]
    more = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(300)] + ["a" * 5000]
    tool = bpe.tokenizer(BPE)
    for t, ids in zip(more, tool.encode_batch(more), strict=True):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids
    coded = bpe.encode(docs.withColumn("ids", F.lit(1)), BPE)
    assert sorted(coded.columns) == sorted([*docs.drop("text").columns, "ids"])
    back = bpe.decode(coded, BPE).select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in texts)
    for r in bpe.digests(docs.where("doc_id < 30"), BPE).collect():
        ids = lib.encode(dict(texts)[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.digests(empty, BPE).count() == 0


VECTOR = "vec_id long, embedding array<float>, label int, cell int, id int"


def _vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    rows += [(100 + k, rows[k][1]) for k in range(20)] + [(200 + k, [x * 1.01 + 0.01 for x in rows[k][1]]) for k in range(20)]
    rows += [(300, None), (301, [float("nan")] * 8), (302, [0.0] * 8), (303, []), (304, [1.0, None] + [0.0] * 6), (None, rows[0][1]), (305, [float("inf")] * 8), (306, [1.0, 2.0])]
    return rows, spark.createDataFrame([(*r, 0, 1, 2) for r in rows], VECTOR)


def test_top_k(spark):
    rows, table = _vectors(spark)
    got = {}
    for r in topk.top_k(spark, table, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    good = {i: v + [0] * (8 - len(v)) for i, v in good.items()}
    for q in (i for i in good if i % 20 == 0):
        score = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(score)]
    assert topk.top_k(spark, table.where("false"), F.col("id") % 20 == 0).count() == 0


def test_top_k_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "STEPS", (1, 3))
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 30)), [float(x) for x in rng.integers(-3, 4, 3)]) for _ in range(300)] + [(40, [1.0, 2.0, 3.0])] * 3
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for a, (q, v) in enumerate(rows):
        if q % 20 == 0:
            score = sorted((-sum(64 * x * 64 * y for x, y in zip(v, w, strict=True)), i) for b, (i, w) in enumerate(rows) if b != a)[:20]
            want += [(q, k + 1, i, int(-s)) for k, (s, i) in enumerate(score)]
    got = [tuple(r) for r in topk.top_k(spark, table, F.col("id") % 20 == 0).collect()]
    assert sorted(got) == sorted(want)


def test_pq(spark):
    rows, table = _vectors(spark)
    got = {r.vec_id: tuple(r)[1:] for r in pq.near_duplicates(spark, table).collect() if r.vec_id is not None}
    sound = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    link = {i: [j for j in sound if j != i and len(sound[j]) == len(sound[i]) and sound[i] @ sound[j] / np.linalg.norm(sound[i]) / np.linalg.norm(sound[j]) >= 0.95] for i in sound}
    for i, _ in rows:
        if i is None:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in link.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (len(link.get(i, [])), min(seen), min(seen) == i)
    assert pq.near_duplicates(spark, table.where("false")).count() == 0


def test_mixing(spark, docs, empty):
    rng = random.Random(9)
    rows = [(k, "x" * rng.choice([0, 3, 40, 400]), rng.choice(["en", "de", None]), f"src{rng.choice([0, 0, 0, 1, 2, 5])}", k) for k in range(800)] + [(5, None, "en", None, 1), (None, "yyyy", "en", "src0", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rest int")
    got = mixing.documents_mixed(spark, table, 60, 3, 4)
    import duckdb

    con = duckdb.connect()
    con.register("documents", table.where("doc_id is not null").toPandas())
    want = con.execute(mixing.document_sql(60, 3, 4)).fetchall()
    con.close()
    mine = mixing.documents_mixed(spark, table.where("doc_id is not null"), 60, 3, 4)
    assert sorted((r.doc_id, r.mix_epoch, r.mix_tokens) for r in mine.collect()) == sorted((w[0], w[4], w[5]) for w in want)
    total = sum(-(-len(r[1] or "") // 4) for r in rows)
    assert 0.5 * total < sum(r.mix_tokens for r in got.collect()) <= 0.6 * total
    assert mixing.mix(spark, empty, {"a": F.col("rest")}, [F.lit(1)], F.expr("sum(tokens)"), 1, 1).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "p string, q string, tokens long")
    got = {(r.p, r.q): r.budget for r in mixing.budgets(leaves, ["p", "q"], [F.lit(1), F.lit(1)], F.lit(400), 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}


def test_warc(spark, tmp_path):
    rng = random.Random(1)
    body = "".join(chr(rng.randint(32, 126)) for _ in range(4000)) + "\x1f"
    rows = [(k, f"http://x/{k}", body if k % 3 == 0 else (None if k == 4 else ("" if k == 7 else f"page é {k}")), 1) for k in range(20)] + [(1, None, "page é 1", 1), (None, "u", "odd", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha int")
    manifest = warc.write(spark, pages, str(tmp_path / "w")).collect()
    table = spark.createDataFrame(manifest, "file string, bytes long, records long")
    for split in (1 << 20, 700, 97):
        got = sorted((r.record_id, r.warc_type, r.payload_length, r.payload_digest, str(r.refers_to)) for r in warc.read(spark, table, split).collect())
        want = []
        for i, _, h, _ in rows:
            first = min(j for j, _, g, _ in rows if j is not None and (g or "") == (h or "")) if i is not None else None
            again = i is not None and first != i
            b = (h or "").encode()
            want.append(("" if i is None else str(i), "revisit" if again else "response", len(b), warc.digest(b), str(first) if again else "None"))
        assert got == sorted(want)
    assert warc.round_trip(spark, pages.where("false")).count() == 0


def test_licenses(spark, docs, empty):
    apache = licenses.TEMPLATES["Apache-2.0-header"]
    broken = apache.replace("compliance", "accordance").replace("writing,", "")
    rows = [(1, "x y " * 500 + "Released under the MIT License. " + "z " * 50), (2, broken), (3, "the license of things"), (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 3.")]
    got = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k in got if k[0] not in (2,)} == {(1, "MIT"), (6, "GPL-3.0")}
    r = got[2, "Apache-2.0-header"]
    assert 0.9 < r.coverage < 1 and got[1, "MIT"].begin == 2000 and got[1, "MIT"].coverage == 1
    assert licenses.scan(empty).count() == 0 and licenses.scan(docs).count() == 0
    # without repeated words an alignment is a longest common subsequence
    rng = random.Random(2)
    for _ in range(200):
        a, b = rng.sample(range(30), 20), rng.sample(range(30), 20)
        table = [[0] * 21 for _ in range(21)]
        for i in range(20):
            for j in range(20):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        pairs = licenses.align([str(x) for x in a], [str(x) for x in b])
        assert len(pairs) == table[20][20] and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(set(pairs))


def _held_out(spark, query, label):
    """Precision, recall and the share of pairs in the right order on the fold never learnt from."""
    from stopgraph.llm import registry

    sf = "/root/testdata/sf0.1"
    rows = registry.QUERIES[query](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", label).collect()
    good = np.array([r.score for r in rows if r[label] == 1])
    bad = np.array([r.score for r in rows if r[label] == 0])
    order = ((good[:, None] > bad[None]).mean() + (good[:, None] >= bad[None]).mean()) / 2
    hits, given = sum(r.predicted and r[label] for r in rows), sum(r.predicted for r in rows)
    return hits / given, hits / len(good), order


def test_toxicity_on_held_out_rows(spark):
    precision, recall, order = _held_out(spark, "op7_toxicity", "toxic")
    assert precision >= 0.95 and recall >= 0.85 and order >= 0.94


def test_quality_on_held_out_rows(spark):
    precision, recall, order = _held_out(spark, "op8_quality", "quality")
    assert precision >= 0.98 and recall >= 0.98 and order >= 0.99


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.2
    said = lambda p, q: np.where(y, rng.random(6000) < p, rng.random(6000) < q)
    one, two, three, four = said(0.9, 0.02), said(0.7, 0.05), said(0.6, 0.01), said(0.8, 0.1)
    copy = np.where(rng.random(6000) < 0.95, four, said(0.8, 0.1))  # repeats the fourth voter
    given = np.stack([one, two, three, four, copy], 1).astype(float)
    post, accuracy, corr = toxicity.label_model(given)
    assert ((post > 0.5) == y).mean() > 0.95
    assert np.abs(accuracy[1, :4, 2] - [0.9, 0.7, 0.6, 0.8]).max() < 0.06 and np.abs(accuracy[0, :4, 2] - [0.02, 0.05, 0.01, 0.1]).max() < 0.03
    assert corr[3, 4] > 0.6 and np.abs(corr[0, 1:3]).max() < 0.2


def test_classifiers(spark, docs, empty):
    rng = random.Random(7)
    rows, toxic, good = [], [], []
    for k in range(400):
        bad, junk = k % 5 == 0, k % 4 == 0
        w = _words(rng, 60).split()
        if bad:
            w[rng.randint(0, 59)] = rng.choice(["vexquil", "vexquon", "idiot"])
        rows.append((k, " | ".join(w) if junk else " ".join(w)))
        toxic.append((k, int(bad), int(not junk)))
    table = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*toxic, (None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(spark, table, labels)
    score = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert sum((score[k] >= 0.5) == bool(t) for k, t, _ in toxic) >= 390 and score[900] == score[901] < 0.5
    model = quality.fit(spark, table, labels)
    score = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert sum((score[k] >= 0.3) == bool(q) for k, _, q in toxic) >= 390 and score[900] == score[901]
    bare = toxicity.fit(spark, table, labels.where("false"))
    assert [r.score > 0.5 for r in toxicity.score(spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string"), bare).orderBy("doc_id").collect()] == [True, False]
    assert quality.fit(spark, table, labels.where("false")).prior == 0.5
    assert toxicity.score(empty, model=bare).count() == 0
