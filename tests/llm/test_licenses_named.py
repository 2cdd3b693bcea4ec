"""Words that name a license must stand in the text; rows that repeat and columns of the result's names."""

import pytest

from stopgraph.llm import licenses

T = licenses.TEMPLATES
OTHERS = [
    "This work is licensed under the GNU General Public License, version 2.",
    "This work is licensed under the GNU Lesser General Public License, version 3.",
    "Licensed under CC BY 3.0.",
    "Licensed under CC BY-SA 4.0.",
    "Licensed under the Apache License, Version 1.1.",
    "Released under the BSD License.",
    "Released under the X11 License.",
    T["LGPL-3.0-header"].replace("version 3", "version 2.1").replace("free software:", "free software;"),
    T["Apache-2.0-header"].replace("2.0", "1.1"),
    T["MPL-2.0"].replace("v. 2.0", "v. 1.1"),
]


@pytest.mark.parametrize("text", OTHERS)
def test_other_licenses_are_not_named(text):
    assert licenses.Templates(T, licenses.COVERAGE).scan(f"some code here\n{text}\nand more") == []


def test_every_template_is_found():
    known = licenses.Templates(T, licenses.COVERAGE)
    for name, text in T.items():
        assert name in {k for k, *_ in known.scan(f"first words. {text} last words.")}, name


def test_damaged_names_and_others_beside():
    known = licenses.Templates(T, licenses.COVERAGE)
    header = T["GPL-3.0-header"].split()
    damaged = " ".join(w for k, w in enumerate(header) if k % 12 or w in ("GNU", "version", "3"))
    assert "GPL-3.0-header" in {k for k, *_ in known.scan(damaged)}
    # one of another version first, then the one that is meant
    both = "Licensed under the Apache License, Version 1.1. " + T["Apache-2.0"]
    assert [(k, n) for k, _, n, _, _ in known.scan(both)] == [("Apache-2.0", 7)]


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, T["MIT"], "x", 5)] * 2 + [(None, T["MIT"], "y", 6), (2, None, "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string, begin int")
    got = licenses.scan(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.license, r.coverage) for r in got) == [(False, 1, "MIT", 1.0)] * 2 + [(True, 0, "MIT", 1.0)]
