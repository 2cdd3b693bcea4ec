"""The pipeline against a brute-force version of each stage on that stage's own input."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, sha string, component_id int, mark int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    insults = ["vexquil", "vexquon", "idiot"]
    passage = _words(rng, 70)
    rows, labels = [], []
    for k in range(260):
        words = _words(rng, rng.randint(40, 120)).split()
        if k % 6 == 0:
            for w in rng.sample(insults, 2):
                words[rng.randint(0, len(words) - 1)] = w
        text = " ".join(words) + (" " + passage if k % 9 == 4 else "")
        labels.append((k, 1, int(k % 6 == 0)))
        rows.append((k, text))
    base = [t for k, t in rows if k % 6 == 1]
    for k, t in enumerate(base[:25]):
        w = t.split()
        w[len(w) // 2] = "changed"
        rows += [(1000 + k, " ".join(w)), (2000 + k, t)]
    rows += [rows[1], rows[1], (None, rows[2][1]), (3000, None), (3001, ""), (3002, " \n"), (7, "another text of the same document " + _words(rng, 60)), (3003, "x"), (3004, _words(rng, 9000))]
    rng.shuffle(rows)
    table = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c"]), len(t or ""), 0.5, "s", 1, k) for k, (i, t) in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(table, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def _set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _near(rows):
    """Ids and texts that stay: each row's component's smallest id is its own."""
    sets = [_set(r[1]) for r in rows]
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, s in enumerate(sets):
        for j in range(i):
            if s and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                top[find(i)] = find(j)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[find(k)] = min(r[0], low.get(find(k), r[0]))
    return {(r[0], r[1]) for k, r in enumerate(rows) if r[0] is None or low[find(k)] == r[0]}


def _cut(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append(np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
    return out


def test_each_stage_and_the_whole(spark, folder):
    import duckdb
    from tokenizers import Tokenizer

    from stopgraph.llm import mixing
    from stopgraph.llm.common import Scratch

    scratch, docs = Scratch(spark), spark.read.parquet(f"{folder}/documents.parquet")
    seen = {"": _rows(docs)}
    before = seen[""]
    for name, stage in pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, folder), f"test-{name}")
        got = _rows(docs)
        if name != "bpe":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        if name == "toxicity":
            assert got == [r for r in before if not re.search("vexqu|idiot", r[1] or "")]
        elif name == "minhash":
            stay = _near(before)
            assert sorted({(str(r[0]), str(r[1])) for r in got}) == sorted({(str(a), str(b)) for a, b in stay})
            assert len(got) == len({(r[0], r[1]) for r in got}) and set(got) <= set(before)
        elif name == "substrings":
            want = [(r[0], t, *r[2:4], len(t), *r[5:]) for r, t in zip(before, _cut([r[1] for r in before]), strict=True) if t]
            assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
            assert sum(len(r[1]) for r in got) < sum(len(r[1] or "") for r in before)
        elif name == "mixing":
            con = duckdb.connect()
            con.register("documents", spark.createDataFrame([r for r in before if r[0] is not None], COLUMNS).toPandas())
            want = sorted(w[0] for w in con.execute(mixing.document_sql(**pipeline.MIX)).fetchall())
            con.close()
            if all(r[0] is not None for r in before):
                assert sorted(r[0] for r in got) == want
            assert set(got) <= set(before) and got
        else:
            lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = []
            for r in before:
                ids = lib.encode(r[1] or "", add_special_tokens=False).ids
                back = lib.decode(ids, skip_special_tokens=False)
                want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
        assert got
        before = got
    assert _rows(pipeline.run(spark, folder)) == before


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
