import random

from stopgraph.llm import licenses


def _longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_notices_that_stand_more_than_once(spark):
    names = ["CC-BY-4.0", "MIT", "MIT-text", "Apache-2.0-header", "BSD-2-Clause", "ISC"]
    rows, want = [], {}
    for name in names:
        for copies in (2, 20):
            for gap in (0, 1, 20, 200):
                text = "filler " * 40 + ("" if not gap else " ").join([licenses.TEMPLATES[name] + " " + "other " * gap] * copies) + " filler" * 40
                want[len(rows)] = (name, 280, 280 + len(licenses.TEMPLATES[name].rstrip(".:")))
                rows.append((len(rows), text))
    got = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (name, begin, end) in want.items():
        r = got[k, name]
        assert (r.coverage, r.begin, r.end) == (1, begin, end), (k, name)


def test_damaged_copies_in_a_row():
    template = [w for w, _, _ in licenses.words(licenses.TEMPLATES["MIT-text"])]
    known = licenses.Templates({"t": " ".join(template)}, 0.8)
    for copies in (2, 20):
        text = " ".join(" ".join(w for k, w in enumerate(template) if k % 10 != c % 10) for c in range(copies))
        ((_, coverage, n, _, _),) = known.scan(text)
        assert n >= len(template) * 0.88 and coverage >= 0.88


def test_windows_are_exact():
    rng = random.Random(3)
    for _ in range(300):
        template = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
        text = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 60))]
        size = -(-3 * len(template) // 2) + licenses.SPARE + 1
        most = max(_longest(text[i : i + size], template) for i in range(len(text)))
        got = licenses.best_window(text, template, 1)
        if not most:
            assert got is None
            continue
        n, begin, end = got
        assert n == most == _longest(text[begin:end], template) and end - begin <= size
        assert licenses.best_window(text, template, most + 1) is None


def test_variants_and_gaps_without_anchors(spark):
    by, nc = licenses.TEMPLATES["CC-BY-4.0"], licenses.TEMPLATES["CC-BY-NC-4.0"]
    gpl, lesser, affero = (licenses.TEMPLATES[f"{k}-3.0-header"] for k in ("GPL", "LGPL", "AGPL"))
    texts = [by, nc, f"foo {by} x y z {nc}", f"{nc} {by}", "Licensed under CC 4.0.", gpl, lesser, affero, gpl.replace("This program", "Foo"), gpl.replace("version 3", "version 2")]
    want = [{"CC-BY-4.0"}, {"CC-BY-NC-4.0"}, {"CC-BY-4.0", "CC-BY-NC-4.0"}, {"CC-BY-4.0", "CC-BY-NC-4.0"}, set(), {"GPL-3.0-header"}, {"LGPL-3.0-header"}, {"AGPL-3.0-header"}, {"GPL-3.0-header"}, {"GPL-2.0-header"}]
    rows = spark.createDataFrame([(k, "a b " * 30 + t + " c d" * 30, "x", 0.5) for k, t in enumerate(texts)], "doc_id long, text string, license string, coverage double")
    got = {}
    for r in licenses.scan(rows).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert [got.get(k, set()) for k in range(len(texts))] == want
    assert len(licenses.align("x a b a b y".split(), "p a b a b q".split())) == 4
    rng = random.Random(3)
    for _ in range(300):
        a, b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        pairs = licenses.subsequence(a, b)
        assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(set(pairs))


def test_very_long_text_and_ties(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "word " * 200_000 + mit + " word" * 10), (2, mit + " and " * 40 + mit), (2, mit), (None, mit), (3, "Released under the MIT")]
    got = sorted((str(r.doc_id), r.license, r.coverage, r.begin) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "MIT", 1.0, 1_000_000), ("2", "MIT", 1.0, 0), ("2", "MIT", 1.0, 0), ("3", "MIT", 0.8, 0), ("None", "MIT", 1.0, 0)]
