"""Results come from the alignment; windows only where they hold more pairs, or as many earlier."""

import random

import pytest

from stopgraph.llm import licenses


def _damaged(rng, template, share):
    """A copy with some words left out, replaced or added."""
    out = []
    for w in template:
        kind = rng.random()
        if kind < share / 3:
            continue
        out.append(f"x{rng.randint(0, 99)}" if kind < 2 * share / 3 else w)
        if kind > 1 - share / 3:
            out.append(f"y{rng.randint(0, 99)}")
    return out


@pytest.mark.parametrize("name", ["MIT-text", "Apache-2.0-header", "BSD-2-Clause", "ISC", "GPL-3.0-header"])
def test_damaged_copies_are_aligned_without_windows(monkeypatch, name):
    template = [w for w, _, _ in licenses.words(licenses.TEMPLATES[name])]
    rng = random.Random(name)
    cases = []
    for _ in range(40):
        before, after = ([f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 60))] for _ in range(2))
        cases.append((before, before + _damaged(rng, template, 0.15) + after))
    exact = [licenses.best_window(text, template, 1) for _, text in cases]
    monkeypatch.setattr(licenses, "best_window", lambda *a: None)
    got = [licenses.aligned(text, template, 1) for _, text in cases]
    assert [g[0] >= 0.97 * e[0] for g, e in zip(got, exact, strict=True)] == [True] * 40
    assert all(g[1] >= len(before) for g, (before, _) in zip(got, cases, strict=True))


def test_never_fewer_pairs_than_a_window_and_the_first_of_equals():
    rng = random.Random(6)
    for _ in range(400):
        template = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
        text = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 60))]
        least = rng.randint(1, len(template))
        window, got = licenses.best_window(text, template, least), licenses.aligned(text, template, least)
        assert (got is None) == (window is None)
        if got:
            assert got[0] == window[0] and got[2] <= window[2]
            assert len(licenses.subsequence(text[got[1] : got[2]], template)) == got[0]


def test_no_window_is_looked_at_for_a_copy_word_for_word(monkeypatch):
    template = [w for w, _, _ in licenses.words(licenses.TEMPLATES["MIT-text"])]
    calls = []
    monkeypatch.setattr(licenses, "_common", lambda words, masks, real=licenses._common: calls.append(len(words)) or real(words, masks))
    assert licenses.aligned(["a"] * 50 + template + ["b"] * 50, template, 10) == (len(template), 50, 50 + len(template))
    assert len(calls) == 2
