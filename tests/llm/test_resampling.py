"""Importance resampling against a brute-force version."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stopgraph.llm import registry, resampling
from stopgraph.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def _words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _features(words, longest):
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _brute(docs, target, longest=1, buckets=10000, percent=10, min_words=20, seed=2024):
    hashed = lambda t: [zlib.crc32(f.encode()) % buckets for f in _features(_words(t), longest)]
    own = [(i, len(_words(t)), hashed(t)) for i, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, b in own:
        for x in b:
            s[x] += 1
    for text in target:
        for x in hashed(text):
            t[x] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (S + buckets) / ((s[k] + 1) * (T + buckets)))) for k in range(buckets)]
    rows = []
    for i, n, b in own:
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    may = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    out = [(*r[:4], None) for r in rows if r[4] < min_words]
    quota = percent * len(may) // 100
    return out + [(*r[:4], k + 1 if k < quota else None) for k, r in enumerate(may)]


def _same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_whole_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    _same(registry.op11_resampling(spark, SF).collect(), _brute(docs, target))


@pytest.fixture(scope="module")
def texts():
    long = " ".join(f"word{k % 977}é" for k in range(40_000))
    same = "the quick brown fox " * 10
    rows = [(1, same), (1, same), (2, same), (None, same), (None, None), (3, ""), (4, None), (5, "!!! ---"), (6, "Übung MACHT den\x00Meister_2"), (7, long), (8, "x" * 3_000_000), (9, "one two")]
    return rows + [(100 + k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(18 + k % 9))) for k in range(120)]


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10000, 10), (2, 97, 50), (3, 65536, 100), (1, 5, 1)])
def test_odd_rows(spark, texts, longest, buckets, percent):
    docs = spark.createDataFrame([(i, t, 1.0, 2, "x") for i, t in texts], "doc_id long, text string, score double, rank int, bucket string")
    target = ["w1 w2 w3 fox", None, "", "MEISTER"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(spark, docs, goal, longest, buckets, percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
    _same(got, _brute(texts, target, longest, buckets, percent))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resampling.resample(spark, none, some).collect() == []
    _same(resampling.resample(spark, some, none, percent=100).select("doc_id", "n_features", "weight", "score", "rank").collect(), _brute([(1, "a b " * 20)], [], percent=100))
    with pytest.raises(ValueError, match="16 bits"):
        resampling.resample(spark, some, none, buckets=70_000)


def test_pieces_do_not_cut_words_or_runs(monkeypatch):
    text = ("Hello, wörld foo_bar 12x\n" * 40).encode()
    whole = {n: sorted(resampling.text_buckets(text, n, 1000)[0].tolist()) for n in (1, 2, 4)}
    monkeypatch.setattr(resampling, "PIECE", 7)
    for n, buckets in whole.items():
        assert sorted(resampling.text_buckets(text, n, 1000)[0].tolist()) == buckets


def test_one_id_holds_many_rows(spark, monkeypatch):
    """Copies of one document with one id share a score; their ranks are still 1, 2, ... without gaps."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(30).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"))
    rows = rows.withColumn("score", F.when(F.col("doc_id") == 7, 5000).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(9000))).cast("long"))
    got = resampling.drawn(Scratch(spark), rows, 60, 20).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1801))
    order = [(-r.score, r.doc_id) for r in got]
    assert order == sorted(order)
