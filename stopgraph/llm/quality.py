"""Text quality by nearest-neighbour voting among latent-semantic vectors.

A text's terms are hashed shapes: runs of character classes in pairs and triples, and
coarse measures of repetition.  Terms are weighted by inverse document frequency over all
documents and projected on the leading directions of a bounded labelled sample.  Every
document's vector is compared exactly, block by block, with all labelled vectors, whose
number is bounded and which are broadcast; the nearest vote with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, binary, byte_slices, held_out, mix, utf8
from .words import word_hashes

#: Hash buckets of terms, latent dimensions, labelled vectors at most, and neighbours that vote.
TERMS, DIMS, FIT_ROWS, NEIGHBOURS = 1024, 48, 4000, 15
#: Power of two that a similarity is raised to as a weight (three squarings), rows of a block,
#: bytes of text worked on at once, and steps of a unit vector's component.
SQUARINGS, BLOCK, CHUNK, SCALE = 3, 512, 1 << 20, 4096.0

# classes: 1 lower case or beyond ASCII, 2 upper case, 3 digit, 4 space, 5 newline, other symbols each their own
_CLASS = np.arange(256) + 16
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[128:] = 4, 5, 1


def term_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of hashed terms, one row a text."""
    n = len(off) - 1
    out = np.zeros((n, TERMS))
    if len(data):
        cls = _CLASS[data]
        owner = np.repeat(np.arange(n), np.diff(off))
        first = np.ones(len(cls), bool)
        first[1:] = (cls[1:] != cls[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        length = np.diff(np.r_[at, len(cls)])
        run = (cls[at] * 8 + np.minimum(np.log2(length).astype(np.int64), 4)).astype(np.uint64)
        doc = owner[at]
        for width, salt in ((1, 11), (2, 23), (3, 37)):
            if len(run) < width:
                continue
            key = np.full(len(run) - width + 1, salt, np.uint64)
            for k in range(width):
                key = mix(key * np.uint64(1099511628211) + run[k : len(run) - width + 1 + k])
            same = doc[: len(key)] == doc[width - 1 :]
            bins = (key[same] % np.uint64(TERMS - 64)).astype(np.int64)
            out += np.bincount(doc[: len(key)][same] * TERMS + bins, minlength=n * TERMS).reshape(n, TERMS)
    # repetition: share of distinct words, of words equal to the one before, and the length
    words, count = word_hashes(data, off)
    ends = np.r_[0, np.cumsum(count)]
    for d in range(n):
        own = words[ends[d] : ends[d + 1]]
        if not len(own):
            out[d, TERMS - 1] += 1
            continue
        distinct = len(np.unique(own)) / len(own)
        again = float((own[1:] == own[:-1]).mean()) if len(own) > 1 else 0.0
        weight = max(8.0, out[d].sum() / 4)
        size = min(int(np.log2(len(own))), 9)
        out[d, TERMS - 64 + min(int(again * 10), 9)] += weight
        out[d, TERMS - 54 + min(int(distinct * 10), 9) + 10 * (size > 6)] += weight
        out[d, TERMS - 30 + size] += weight / 4
    return out


@dataclass
class Model:
    """What scoring needs: weights of terms, directions, labelled vectors and their labels."""

    weight: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    prior: float


def _weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * weight
    return x / np.maximum(np.sqrt((x**2).sum(1)), 1e-12)[:, None]


def _latent(counts: np.ndarray, weight: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Unit vectors in whole steps of ``1 / SCALE``: their products are exact, whatever the block."""
    z = _weighted(counts, weight) @ directions
    return np.rint(SCALE * z / np.maximum(np.sqrt((z**2).sum(1)), 1e-12)[:, None])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Document frequencies over all of ``docs``; directions and votes of at most ``FIT_ROWS``.

    ``labels(doc_id, quality)``: rows of the held-out fold, and of null id or label, are
    left out; of an id labelled twice the larger label counts.  Without labels every score
    is the prior, one half.
    """
    scratch = Scratch(spark)

    def frequencies(batches):
        total, n = np.zeros(TERMS, np.int64), 0
        for b in batches:
            data, off = utf8(b.column(0))
            for i, j in byte_slices(off, CHUNK):
                total += (term_counts(data[off[i] : off[j]], off[i : j + 1] - off[i]) > 0).sum(0)
                n += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.r_[total, n])], ["term", "n"])

    seen = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(TERMS + 1)
    for r in seen:  # one row a term
        df[r.term] = r.n
    weight = np.log((1 + df[TERMS]) / (1 + df[:TERMS])) + 0.1

    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).where(~held_out()).where("quality in (0, 1)")
    # at most FIT_ROWS ids, so they are broadcast and texts stay where they are
    known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    rows = docs.select("doc_id", "text").join(known, "doc_id").select("text", "quality")
    sample = scratch.table(rows.repartition(max(2, spark.sparkContext.defaultParallelism)), "labelled")

    def counted(batches):
        for b in batches:
            data, off = utf8(b.column(0))
            for i, j in byte_slices(off, CHUNK):
                yield pa.RecordBatch.from_arrays([binary(term_counts(data[off[i] : off[j]], off[i : j + 1] - off[i]).astype(np.float32)), b.column(1).slice(i, j - i)], ["counts", "quality"])

    got = sample.mapInArrow(counted, "counts binary, quality int").collect()
    scratch.drop("labelled")
    if not got:
        return Model(weight, np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    got.sort(key=lambda r: (bytes(r.counts), r.quality))
    counts = np.frombuffer(b"".join(bytes(r.counts) for r in got), np.float32).reshape(-1, TERMS)
    label = np.array([r.quality for r in got], float)
    x = _weighted(counts, weight)
    value, vector = np.linalg.eigh(x.T @ x)
    top = np.argsort(value)[::-1][:DIMS]
    directions = vector[:, top] * np.where(vector[np.abs(vector[:, top]).argmax(0), top] < 0, -1, 1)
    return Model(weight, directions, _latent(counts, weight, directions), label, float(label.mean()))


def votes(z: np.ndarray, model: Model) -> np.ndarray:
    """The labels of the nearest labelled vectors, weighted by similarity."""
    if not len(model.vectors):
        return np.full(len(z), model.prior)
    k = min(NEIGHBOURS, len(model.vectors))
    out = np.empty(len(z))
    for a in range(0, len(z), BLOCK):
        cosine = z[a : a + BLOCK] @ model.vectors.T / SCALE**2
        last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        w = np.where(cosine >= last, np.maximum(cosine, 1e-3), 0)  # with all as near as the last one
        for _ in range(SQUARINGS):
            w *= w
        out[a : a + BLOCK] = (w @ model.label + 1e-9 * model.prior) / (w.sum(1) + 1e-9)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns and ``score``, the share of votes for good, of every whole text.

    A null or empty text is compared by its only term, the lack of words.  Labelled vectors
    as near as the last of the ``NEIGHBOURS`` all vote, so ties have no order; repeated rows
    score alike; other columns are ignored; an empty table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    rest = [f for f in docs.schema if f.name in keep and f.name != name]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{name}` double"])

    def run(batches):
        for b in batches:
            data, off = utf8(b.column(0))
            for i, j in byte_slices(off, CHUNK):
                z = _latent(term_counts(data[off[i] : off[j]], off[i : j + 1] - off[i]), model.weight, model.directions)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(1, b.num_columns)), pa.array(votes(z, model))], [f.name for f in rest] + [name])

    return docs.select(F.col("text").alias("__text"), *[F.col(f.name) for f in rest]).mapInArrow(run, schema)
