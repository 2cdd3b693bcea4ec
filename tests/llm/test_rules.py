"""Quality rules: base figures against a brute-force version, verdicts against SQL and labels."""

import collections
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from stopgraph.llm import registry, rules

SF = "/root/testdata/sf0.01"


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab[: rng.choice([5, 20, 300])]) for _ in range(n))
    one = prose(60)
    rows = [(k, prose(rng.randint(5, 400)), "en") for k in range(60)]
    rows += [(70, None, "en"), (71, "", None), (72, " \t\n\x0b\x0c\r ", "xx"), (73, "la " * 30_000, "en"), (74, one, None), (74, one, None), (None, one + " " + one, "en"), (75, "été ß 😀 #|<> " * 9, "fr")]
    rows += [(76, "a b c d e f g h", "en"), (77, "a b c d e f g h a b c d e f g h", "en"), (78, "a a a a a a a a a", "en"), (79, "same line\nsame line\n\n \nother\nsame line \nsame line", "en"), (80, "\x00 nul", "en"), (81, "\n\n", "en")]
    return rows


def test_base_figures(spark, texts):
    df = spark.createDataFrame([(i, t, lang, 1, "x", [1.0]) for i, t, lang in texts], "doc_id long, text string, lang string, kept int, n_words string, chars array<double>")
    got = rules.assess(spark, df).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(((i, *_base(t)) for i, t, _ in texts), key=key)
    assert not [r for r in got if r.base_failed and r.kept]


def test_empty(spark, texts):
    assert rules.assess(spark, spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    # of a language of few words nothing is said beyond the base rules
    few = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(90)), "en")], "doc_id long, text string, lang string")
    row = rules.assess(spark, few).first()
    assert row.kept and row.word_divergence is None and row.char_divergence is None


def test_divergence(spark):
    p, q = [3, 0, 5, 2], [1, 4, 0, 7]
    got = spark.range(1).select(rules.divergence(F.array(*map(F.lit, p)), F.lit(sum(p)), F.array(*map(F.lit, q)), F.lit(sum(q))).alias("d")).first().d
    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda x, y: sum(u * math.log2(2 * u / (u + v)) for u, v in zip(x, y, strict=True) if u)
    assert abs(got - (half(a, b) + half(b, a)) / 2) < 1e-12


def test_whole_query_equals_sql_and_brute_force(spark):
    got = {r.doc_id: r for r in registry.op13_rules(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert {d.doc_id: _base(d.text) for d in docs} == {i: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for i, r in got.items()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert {r[0]: r[-3:] for r in con.execute(rules.sql()).fetchall()} == {i: (r.char_failed, r.word_failed, r.kept) for i, r in got.items()}


def test_labels(spark):
    """Documents labelled good stay unless the base rules fail; most of those labelled bad go."""
    got = registry.op13_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    good = got.where("quality = 1 and not base_failed").agg(F.count("*"), F.count_if("kept")).first()
    bad = got.where("quality = 0").agg(F.count("*"), F.count_if("kept")).first()
    assert good[1] >= 0.99 * good[0] and bad[1] <= 0.25 * bad[0]
