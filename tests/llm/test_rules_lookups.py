"""Common words by one set and windows by slices: the same figures, whatever the number of languages."""

import random

from stopgraph.llm import rules


def test_set_of_common_words_changes_nothing(spark, monkeypatch):
    """Before, each word was compared with all of its language's common words."""
    rng = random.Random(1)
    text = lambda lang, n: " ".join(f"{lang}{min(int(rng.expovariate(0.1)), 90)}" for _ in range(n))
    rows = [(k, text("ab"[k % 2], rng.randint(5, 300)), "ab"[k % 2]) for k in range(60)] + [(60, " \t x\ry  z ", "a"), (61, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    listed = sorted(map(str, rules.assess(spark, docs).collect()))
    monkeypatch.setattr(rules, "MOST_LISTED", 0)
    assert sorted(map(str, rules.assess(spark, docs).collect())) == listed
    totals = {r.lang: r.ref_total for r in rules.references(docs).collect()}
    assert totals == {lang: sum(len((t or "").split()) for _, t, x in rows if (x or "") == lang) for lang in ("a", "b", "")}
