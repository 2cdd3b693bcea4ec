"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters look at a text and vote toxic, clean or nothing: word lists of several languages,
terms mined from the labelled rows (words and word beginnings, and beginnings that stand
several times in one text), and patterns.  A generative model of the votes alone estimates
how often each voter is right in either class and how voters hang together: given the class
the votes form trees, each one's probability depending on the vote that it is correlated
with most.  Class and tree are estimated by expectation maximisation, without the labels,
and the model's posterior probabilities are what a logistic classifier over terms and votes
is trained on.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held_out, released

#: Insults of four languages, by list.
LEXICONS = {
    "insult": "idiot idiots moron morons stupid fool clown loser losers dumb imbecile jerk",
    "contempt": "worthless pathetic disgusting trash scum garbage vermin filth hate",
    "german": "idioten dummkopf arschloch abschaum dreck trottel",
    "french": "idiote imbécile connard ordure crétin abruti",
    "spanish": "idiota imbécil estúpido basura escoria asqueroso",
}
#: Labelled rows that the models are fitted to at most, chosen by a hash of their id.
FIT_ROWS = 20_000
#: Candidates and chosen ones of the mined terms at most, those of them that vote, and
#: labelled documents that a term needs.
MINED, CHOSEN, VOTERS, SUPPORT = 4000, 400, 40, 3
#: Share of the labelled documents with a mined term that are toxic, at least.
PRECISION = 0.9
#: Terms that should vouch for each toxic document, lengths of word beginnings, and times
#: that a beginning stands in a text.
NEED, BEGINNINGS, TIMES = 5, (4, 5, 6, 7), (2, 3)
#: Rounds of the label model, and rounds after which its tree is chosen anew.
ROUNDS, REGROW = 24, 6
#: Mutual information (nats) given the class from which on two voters depend on each other.
DEPENDS = 0.05
#: Chance of a false alarm up to which a voter is hardly doubted, and that of the lists and patterns.
DOUBTED, OF_LISTS = 0.02, 0.002
STEPS, PENALTY = 400, 1e-3
#: Steepness of the score about its border.
SHARP = 2.0
_WORD = re.compile(r"[^\W\d_]+")
_ATTACK = re.compile(r"\b(?:you|they|he|she)(?:'re| are|'s| is) (?:an? |such an? |nothing but )?\w+", re.I)


@dataclass
class Model:
    """What scoring needs; its size is bounded by ``MINED`` and the voters."""

    words: list[str]
    word_weight: np.ndarray
    vote_weight: np.ndarray
    bias: float
    accuracy: np.ndarray
    correlation: np.ndarray


def _matcher(terms: list[str]):
    """Finds terms: words, or beginnings of longer words ('*'), or those several times ('*2')."""
    if not terms:
        return None
    ends: dict[str, list[tuple[int, bool, int]]] = {}
    for k, t in enumerate(terms):
        word, star, times = t.partition("*")
        ends.setdefault(word, []).append((k, bool(star), int(times or 1)))
    found = ahocorasick.Automaton()
    for w, kinds in ends.items():
        found.add_word(w, (len(w), kinds))
    found.make_automaton()
    return found


def present(text: str, matcher) -> set[int]:
    """Which of the matcher's terms stand in ``text``, as often as they have to."""
    if matcher is None:
        return set()
    low, left = text.lower(), {}
    for end, (n, kinds) in matcher.iter(low):
        begin = end - n + 1
        if begin and low[begin - 1].isalpha():
            continue
        more = end + 1 < len(low) and low[end + 1].isalpha()
        for k, start, times in kinds:
            if start == more:
                left[k] = left.get(k, times) - 1
    return {k for k, n in left.items() if n <= 0}


def _listed() -> list[str]:
    return [w for words in LEXICONS.values() for w in words.split()]


def votes(attack: int, chars: int, listed: set[int], mined: set[int], voters: int = VOTERS) -> np.ndarray:
    """One of -1 (clean), 0 and 1 (toxic) from each voter; terms numbered below ``voters`` vote."""
    out, at = [], 0
    for words in LEXICONS.values():
        n = len(words.split())
        out.append(int(any(at <= k < at + n for k in listed)))
        at += n
    out += [int(k in mined) for k in range(voters)]
    out.append(1 if len(mined) + len(listed) > 2 else 0)  # several hits
    out.append(-1 if not mined and not listed else 0)  # none
    out.append(1 if attack and listed else 0)  # an insult and an address
    out.append(-1 if chars < 40 and not listed else 0)  # too short to tell
    return np.array(out, np.int8)


def _mine(sample: DataFrame) -> list[str]:
    """Candidate terms: nearly only in toxic labelled documents, by counts of documents."""

    def count(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = [w for w in _WORD.findall((text or "").lower()) if 2 < len(w) < 40]
                begun = Counter(w[:n] for w in words for n in BEGINNINGS if len(w) > n)
                terms = set(words) | {w + "*" for w in begun} | {f"{w}*{k}" for w, n in begun.items() for k in TIMES if n >= k}
                for w in terms:
                    seen.setdefault(w, [0, 0])[label] += 1
            if len(seen) > 100_000:
                yield _counts(seen)
                seen = {}
        if seen:
            yield _counts(seen)

    counts = sample.select("text", "toxic").mapInArrow(released(count), "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = counts.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))))
    return [r.word for r in best.orderBy(F.desc("toxic"), "word").limit(MINED).collect()]


def _choose(rows: list[list[int]], label: list[int], n: int) -> list[int]:
    """Terms by greedy cover: the next is new to most toxic documents that still need one.

    Words that only come along in copies of a toxic document add nothing once a term that
    many toxic documents share covers it, so they are not chosen.
    """
    having: list[list[int]] = [[] for _ in range(n)]
    clean = np.zeros(n)
    for d, (row, y) in enumerate(zip(rows, label, strict=True)):
        for k in row:
            if y:
                having[k].append(d)
            else:
                clean[k] += 1
    need = np.full(len(rows), NEED)
    gain = np.array([len(h) for h in having]) - clean
    least = max(SUPPORT, 0.002 * sum(label))
    chosen = []
    while len(chosen) < CHOSEN and n:
        k = int(gain.argmax())
        now = float((need[having[k]] > 0).sum() - clean[k])
        if now < gain[k]:
            gain[k] = now
            if gain.max() > now:
                continue
        if now < least:
            break
        chosen.append(k)
        need[having[k]] -= 1
        gain[k] = -np.inf
    return chosen


def _counts(seen: dict[str, list[int]]) -> pa.RecordBatch:
    words = list(seen)
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w][0] for w in words], pa.int64()), pa.array([seen[w][1] for w in words], pa.int64())], ["word", "clean", "toxic"])


def _tree(pairs: np.ndarray) -> np.ndarray:
    """Each voter's parent in the forest of most mutual information given the class; -1 for a root.

    Pairs with less than ``DEPENDS`` of it count as independent.

    ``pairs[c, j, v, k, w]`` is the probability of class c with votes v of j and w of k.
    """
    m = pairs.shape[1]
    within = pairs / pairs[:, :, :, :1].sum((2, 4), keepdims=True)  # given the class
    one, other = within.sum(4, keepdims=True), within.sum(2, keepdims=True)
    share = pairs[:, 0, :, 0].sum((1, 2))
    gain = np.einsum("c,cjvkw->jk", share, within * np.log(within / (one * other)))
    parent, best = np.full(m, -1), gain[0].copy()
    nearest, inside = np.zeros(m, int), np.zeros(m, bool)
    inside[0] = True
    for _ in range(m - 1):
        k = int(np.where(inside, -np.inf, best).argmax())
        parent[k], inside[k] = nearest[k] if best[k] >= DEPENDS else -1, True
        closer = gain[k] > best
        best[closer], nearest[closer] = gain[k][closer], k
    return parent


def label_model(given: np.ndarray, doubt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, the voters' accuracies and their correlations.

    ``accuracy[c, j, v]`` is the probability of vote v - 1 of voter j in class c.  Given the
    class, votes are trees: a vote depends on its parent's, so what a voter only repeats
    counts once.  Rows start from the balance of their votes; no label is looked at.
    ``doubt`` is what is known beforehand of each voter, the chance that it calls a clean row
    toxic: it counts like a quarter of the rows, and a row that a hardly doubted voter calls
    toxic starts as such, so that the classes keep their meaning.
    """
    n, m = given.shape
    onehot = np.stack([given == v for v in (-1, 0, 1)], 2).astype(np.float32)
    flat = onehot.reshape(n, 3 * m)
    # voters that go together from the start share a vote
    sd = given.std(0)
    centred = (given - given.mean(0)) / np.where(sd > 0, sd, 1)
    weight = 1 / np.maximum(((centred.T @ centred / n) ** 4).sum(1), 1)
    balance = given @ weight
    post = np.where(balance > 1.25, 0.9, np.where(balance > 0, 0.6, 0.05))
    known = np.zeros((m, 3))
    if doubt is not None:
        post = np.where((given[:, doubt < DOUBTED] > 0).any(1), 0.9, post)
        less = (given < 0).mean(0)
        known = np.stack([less, np.maximum(1 - less - doubt, 0), doubt], 1) + 1e-4
        known /= known.sum(1, keepdims=True)
    parent = np.full(m, -1)
    for turn in range(ROUNDS):
        mass = np.stack([1 - post, post]).astype(np.float32)
        pairs = np.stack([(flat * w[:, None]).T @ flat for w in mass]).reshape(2, m, 3, m, 3).astype(float)
        if doubt is not None:
            pairs[0] += n / 4 * np.einsum("jv,kw->jvkw", known, known)
        pairs = (pairs + 0.05) / (n + 0.9)
        if turn % REGROW == 0:
            parent = _tree(pairs)
        share = np.clip(mass.sum(1) / n, 1e-3, 1)
        accuracy = pairs[:, :, :, 0].sum(3)
        accuracy /= accuracy.sum(2, keepdims=True)
        logit = np.full(n, np.log(share[1] / share[0]))
        for j in range(m):
            if parent[j] < 0:
                odds = np.log(accuracy[1, j] / accuracy[0, j])
                logit += onehot[:, j] @ odds
            else:
                both = pairs[:, j, :, parent[j]]
                both = both / both.sum(1, keepdims=True)  # of the vote, given class and parent's vote
                odds = np.log(both[1] / both[0])
                logit += np.einsum("nv,vw,nw->n", onehot[:, j], odds, onehot[:, parent[j]])
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    corr = np.zeros((m, m))
    for c in (0, 1):
        centred = given - (mass[c][:, None] * given).sum(0) / max(mass[c].sum(), 1e-9)
        cov = (centred * mass[c][:, None]).T @ centred / max(mass[c].sum(), 1e-9)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr += mass[c].sum() / n * np.where((sd[:, None] > 1e-5) & (sd[None] > 1e-5), cov / np.outer(sd, sd), 0)
    held = np.eye(m, dtype=bool)
    linked = np.flatnonzero(parent >= 0)
    held[linked, parent[linked]] = held[parent[linked], linked] = True
    return post, accuracy, np.where(held, corr, 0)  # the model's correlations are those of its trees


def _features(word_rows: list[list[int]], given: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column numbers of the words present, and the votes as numbers."""
    size = np.array([len(r) for r in word_rows], np.int64)
    return np.repeat(np.arange(len(word_rows)), size), np.array([k for r in word_rows for k in r], np.int64), given.astype(float)


def _train(word_rows: list[list[int]], given: np.ndarray, post: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    row, col, v = _features(word_rows, given, n_words)
    n = len(post)
    w, u, bias = np.zeros(n_words), np.zeros(v.shape[1]), 0.0
    pw, pu, pb = w, u, bias
    rate = 4.0 / (1 + (np.bincount(row, minlength=n).max(initial=0) + v.shape[1]) / 8)
    balance = np.where(post > 0.5, 0.5 / max((post > 0.5).mean(), 1e-3), 0.5 / max((post <= 0.5).mean(), 1e-3))
    for t in range(STEPS):
        k = t / (t + 3)
        yw, yu, yb = w + k * (w - pw), u + k * (u - pu), bias + k * (bias - pb)
        z = np.bincount(row, yw[col], minlength=n) + v @ yu + yb
        g = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - post) / n
        pw, pu, pb = w, u, bias
        w = yw - rate * (np.bincount(col, g[row], minlength=n_words) + PENALTY * yw)
        u = yu - rate * (v.T @ g + PENALTY * yu)
        bias = yb - rate * g.sum()
    # the border lies where it parts the posterior labels best, half way between two rows
    z = np.bincount(row, w[col], minlength=n) + v @ u
    order = np.argsort(z, kind="stable")
    hard = post[order] > 0.5
    hits = hard.sum() - np.r_[0, np.cumsum(hard)]  # of the rows from each place on
    f1 = 2 * hits / np.maximum(hard.sum() + n - np.arange(n + 1), 1)
    ends = np.r_[z[order][:1] - 1, z[order], z[order][-1:] + 1]
    f1[1:-1][ends[1:-2] == ends[2:-1]] = -1
    k = int(f1.argmax())
    border = (ends[k] + ends[k + 1]) / 2
    return SHARP * w, SHARP * u, float(-SHARP * border)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Fit to at most ``FIT_ROWS`` labelled rows outside the held-out fold.

    ``labels(doc_id, toxic)``; rows of null id or label are left out, of an id labelled
    twice the larger label counts.  Without labels the model knows its word lists only.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out()).where("toxic in (0, 1)")
    # at most FIT_ROWS ids, so they are broadcast and texts stay where they are
    known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    rows = docs.select("doc_id", "text").join(known, "doc_id").select("text", "toxic")
    scratch = Scratch(spark)
    sample = scratch.table(rows.repartition(max(2, spark.sparkContext.defaultParallelism)), "labelled")
    candidates = _mine(sample)
    listed = _listed()

    def look(batches):
        a, b = _matcher(listed), _matcher(candidates)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            pairs = [(sorted(present(t, a)), sorted(present(t, b)), int(bool(_ATTACK.search(t))), len(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.int32())), pa.array([p[2] for p in pairs], pa.int32()), pa.array([p[3] for p in pairs], pa.int64()), batch.column(1)], ["listed", "terms", "attack", "chars", "toxic"])

    seen = sample.mapInArrow(released(look), "listed array<int>, terms array<int>, attack int, chars long, toxic int").collect()
    scratch.drop("labelled")
    seen.sort(key=lambda r: (r.terms, r.listed, r.attack, r.chars, r.toxic))
    chosen = _choose([r.terms for r in seen], [r.toxic for r in seen], len(candidates))
    # in the order they were chosen: the first cover most, and vote
    words, rank = [candidates[k] for k in chosen], {k: j for j, k in enumerate(chosen)}
    mined = [sorted(rank[k] for k in r.terms if k in rank) for r in seen]
    m = len(LEXICONS) + VOTERS + 4
    prior = np.concatenate([np.full(len(LEXICONS), 4.0), np.full(VOTERS, 0.0), [0.5, 0.0, 1.0, 0.0]])
    if not any(r.toxic == 1 for r in seen) or not any(r.toxic == 0 for r in seen):
        return Model([], np.zeros(0), prior, -3.0, np.full((2, m, 3), 1 / 3), np.eye(m))
    given = np.array([votes(r.attack, r.chars, set(r.listed), set(w)) for r, w in zip(seen, mined, strict=True)])
    # what mining has seen of each term: the share of clean rows that hold it
    clean = max(sum(r.toxic == 0 for r in seen), 1)
    doubt = np.full(m, OF_LISTS)
    for k in range(min(VOTERS, len(words))):
        doubt[len(LEXICONS) + k] = (sum(k in w and r.toxic == 0 for r, w in zip(seen, map(set, mined), strict=True)) + 0.5) / (clean + 1)
    post, accuracy, corr = label_model(given.astype(float), doubt)
    w, u, bias = _train(mined, given, post, len(words))
    # a list that no labelled row holds keeps a weight of its own
    unseen = (given[:, : len(LEXICONS)] == 0).all(0)
    u[: len(LEXICONS)] = np.where(unseen, prior[: len(LEXICONS)], u[: len(LEXICONS)])
    return Model(words, w, u, bias, accuracy, corr)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns and ``score``, the probability of toxic, of every whole text.

    A null or empty text gets the score of a text without words; ties, repeated rows and
    extra columns need nothing special; an empty table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    rest = [f for f in docs.schema if f.name in keep and f.name != name]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{name}` double"])

    def run(batches):
        a, b = _matcher(_listed()), _matcher(model.words)
        for batch in batches:
            out = []
            for value in batch.column(0):
                text = value.as_py() or ""
                mined = present(text, b)
                v = votes(int(bool(_ATTACK.search(text))), len(text), present(text, a), mined)
                z = model.bias + float(v @ model.vote_weight) + float(sum(model.word_weight[k] for k in sorted(mined)))
                out.append(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1, batch.num_columns)), pa.array(out, pa.float64())], [f.name for f in rest] + [name])

    return docs.select(F.col("text").alias("__text"), *[F.col(f.name) for f in rest]).mapInArrow(released(run), schema)


def toxic(threshold: float = 0.5, name: str = "score") -> Column:
    return F.col(name) >= threshold
