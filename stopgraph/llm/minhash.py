"""Near-duplicate documents by HyperMinHash registers, banding and exact verification.

A document's distinct word shingles are dealt to registers by a hash; a register keeps the
smallest value dealt to it, compressed to the count of its leading zeros and ten mantissa
bits.  Registers that stay empty are dealt to again in further seeded rounds whose values
rank above all earlier ones, so short documents fill theirs without bias (each register
still agrees between two documents with the probability of their Jaccard similarity).

Bands of registers give candidate buckets.  Each document is first compared with the
smallest id of its buckets only, then with a drawn member or two; members of buckets that
this leaves in more than one component are compared with each other in blocks, each of which
returns no more than a forest of links.  A candidate's similarity is estimated from its
agreeing registers, corrected for chance collisions, and confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, binary, by_group, byte_slices, mix, released, spread_join, utf8
from .components import connected_components
from .words import shingle_sets

#: Registers, those of a band, and bands; the bands take the first half of the registers, all
#: of them serve the estimate.
REGISTERS, ROWS, BANDS = 320, 5, 32
MANTISSA = 10
#: Bytes of text sketched at once, and members of a block in the second comparison.
CHUNK, BLOCK, SHINGLES, TRIED = 1 << 19, 512, 1 << 19, 32
#: Chance that two unrelated registers agree: equal leading zeros (about 1/3) and mantissa.
COLLISION = 1 / 3 / (1 << MANTISSA)
#: Standard deviations below the threshold down to which an estimate still is a candidate.
SLACK = 3.6
#: Rounds in which each document is compared with one drawn member of its buckets.
ROUNDS = 2


def registers(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The compressed registers of each set, one row a set; an empty set has zeros only."""
    n = len(sizes)
    top = np.iinfo(np.uint64).max
    low = np.full(n * REGISTERS, top, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    left = shingles
    done = 0
    empty = np.full(n, REGISTERS)
    while len(left) and done < 2 * REGISTERS:
        h = mix(left + np.uint64((done * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        if done < REGISTERS:
            slot = ((h >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        else:  # the last rounds deal everything to one register each
            slot = np.uint64(done - REGISTERS)
        value = (np.uint64(done) << np.uint64(52)) | (mix(h) >> np.uint64(12))
        np.minimum.at(low, owner * REGISTERS + slot.astype(np.int64), value)
        done += 1
        if done <= 2 or done % 4 == 0 or len(left) > 100_000:
            empty = (low.reshape(n, REGISTERS) == top).sum(1)
            more = empty[owner] > 0
            left, owner = left[more], owner[more]
    low = low.reshape(n, REGISTERS)
    turn = low >> np.uint64(52)
    fraction = (low & np.uint64((1 << 52) - 1)).astype(np.float64)  # 52 bits: exact
    mantissa, exponent = np.frexp(fraction)
    zeros = np.where(fraction > 0, 52 - exponent, 53).astype(np.uint64)
    bits = (np.maximum(mantissa * 2 - 1, 0) * (1 << MANTISSA)).astype(np.uint64)
    packed = (zeros << np.uint64(MANTISSA)) | bits
    # a later round's value is told apart by the round, folded into the same sixteen bits
    folded = (packed + turn * np.uint64(40503)) & np.uint64(0xFFFF)
    out = folded.astype(np.uint16)
    out[sizes == 0] = 0
    return out


SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, sketch binary, text_hash long"


def sketch(docs: DataFrame) -> DataFrame:
    """Each document's set size, a 128-bit fingerprint of its set, its registers and a hash of its text."""

    def run(batches):
        for b in batches:
            data, off = utf8(b.column(1))
            for i, j in byte_slices(off, CHUNK):
                s, sizes = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ends = np.zeros(len(sizes) + 1, np.int64)
                np.cumsum(sizes, out=ends[1:])
                prints = []
                for seed in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
                    run_ = np.zeros(len(s) + 1, np.uint64)
                    np.cumsum(mix(s ^ np.uint64(seed)), out=run_[1:])
                    prints.append(mix(run_[ends[1:]] - run_[ends[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sizes), pa.array(prints[0]), pa.array(prints[1]), binary(registers(s, sizes)), b.column(2).slice(i, j - i)], ["doc_id", "n_shingles", "set_a", "set_b", "sketch", "text_hash"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string"))).mapInArrow(released(run), SKETCH)


def _least_agreeing(threshold: float) -> int:
    """Agreeing registers that a candidate needs."""
    floor = threshold - SLACK * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    return int(np.ceil((floor * (1 - COLLISION) + COLLISION) * REGISTERS))


def estimate(agreeing: np.ndarray) -> np.ndarray:
    """Jaccard similarity from agreeing registers, less those expected by chance."""
    return np.clip((agreeing / REGISTERS - COLLISION) / (1 - COLLISION), 0, 1)


def _estimated(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose registers and sizes let them reach the threshold."""
    least = _least_agreeing(threshold)
    own = sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("n"))
    other = sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("m"))
    both = pairs.join(own, "a").join(other, "b").where(F.least("n", "m") >= threshold * F.greatest("n", "m")).select("a", "b", "x", "y")

    def run(batches):
        for b in batches:
            x = utf8(b.column(2))[0].view(np.uint16).reshape(-1, REGISTERS)
            y = utf8(b.column(3))[0].view(np.uint16).reshape(-1, REGISTERS)
            near = pa.array((x == y).sum(1) >= least)
            yield b.select([0, 1]).filter(near)

    return both.mapInArrow(released(run), "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` with 100 * intersection >= percent * union on full sets."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            size = utf8(batch.column(2))[1] + utf8(batch.column(3))[1]
            for i, j in byte_slices(size, CHUNK):
                part = batch.slice(i, j - i)
                dx, ox = utf8(part.column(2))
                dy, oy = utf8(part.column(3))
                sx, nx = shingle_sets(dx, ox)
                sy, ny = shingle_sets(dy, oy)
                # a shingle of both sets stands twice where a pair's sets are put together
                owner = np.concatenate([np.repeat(np.arange(j - i), nx), np.repeat(np.arange(j - i), ny)])
                order = np.lexsort((np.concatenate([sx, sy]), owner))
                s, o = np.concatenate([sx, sy])[order], owner[order]
                twice = (s[1:] == s[:-1]) & (o[1:] == o[:-1])
                shared = np.bincount(o[1:][twice], minlength=j - i)
                near = 100 * shared >= percent * (nx + ny - shared)
                yield part.select([0, 1]).filter(pa.array(near & (nx > 0) & (ny > 0)))

    return both.mapInArrow(released(run), "a long, b long")


def _sets(texts: DataFrame) -> DataFrame:
    """``(id, set)``: each text's sorted shingle hashes."""

    def run(batches):
        for b in batches:
            data, off = utf8(b.column(1))
            for i, j in byte_slices(off, CHUNK):
                s, sizes = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ends = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum(8 * sizes, out=ends[1:])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(s.tobytes())])], ["id", "set"])

    return texts.select("doc_id", "text").mapInArrow(released(run), "id long, set binary")


def _shared(sets: np.ndarray, at: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
    """How many shingles set ``k`` shares with each of ``others``; none of them is empty."""
    own = sets[at[k] : at[k + 1]]
    size = at[others + 1] - at[others]
    begin = np.cumsum(size) - size
    items = sets[np.repeat(at[others] - begin, size) + np.arange(size.sum())]
    place = np.minimum(np.searchsorted(own, items), len(own) - 1)
    return np.add.reduceat((own[place] == items).astype(np.int64), begin)


def _block_links(members: DataFrame, sketches: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """A forest of the links between members of a bucket that are in different components.

    ``members(bucket, id, component)``.  Buckets of equal members count once.  A bucket is
    cut into blocks of about ``BLOCK`` members or ``SHINGLES`` shingles; each pair of blocks
    is compared in one call: pairs that the registers allow are confirmed on the full sets,
    unless links found before join the two already.  A call returns fewer links than it has
    members, whatever the number of similar pairs.
    """
    threshold = percent / 100
    least = _least_agreeing(threshold)
    own = sketches.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch")
    members = members.select("bucket", "id", "component").join(own, "id")
    alike = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"mark_{k}") for k in range(2)]
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("total"), *alike)
    sizes = sizes.groupBy("size", "total", "mark_0", "mark_1").agg(F.min("bucket").alias("bucket"))
    sizes = sizes.select("bucket", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / SHINGLES)).cast("int").alias("blocks"))
    sets = _sets(texts.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    cut = members.join(sizes, "bucket").join(sets, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("is_first"), (F.col("own") >= F.col("other")).alias("is_second"), "id", "component", "n", "sketch", "set")

    def run(table: pa.Table):
        ids, comp, n = (table.column(c).to_numpy() for c in ("id", "component", "n"))
        if comp.min() == comp.max():
            return None
        one = np.flatnonzero(table.column("is_first").to_numpy(zero_copy_only=False))
        two = np.flatnonzero(table.column("is_second").to_numpy(zero_copy_only=False))
        label = np.unique(comp, return_inverse=True)[1]
        regs = utf8(table.column("sketch"))[0].view(np.uint16).reshape(-1, REGISTERS)
        data, off = utf8(table.column("set"))
        sets, at = data.view(np.uint64), off // 8
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        a, b = [], []
        for k in one.tolist():
            rest = two[ids[two] > ids[k]] if within else two
            rest = rest[(label[rest] != label[k]) & (np.minimum(n[rest], n[k]) >= threshold * np.maximum(n[rest], n[k]))]
            same = (regs[rest] == regs[k]).sum(1)
            rest = rest[same >= least][np.argsort(-same[same >= least], kind="stable")]
            while len(rest):  # the likeliest first, as a link makes others needless
                some, rest = rest[:TRIED], rest[TRIED:]
                shared = _shared(sets, at, k, some)
                for m in some[100 * shared >= percent * (n[k] + n[some] - shared)].tolist():
                    if label[m] != label[k]:
                        label[label == label[m]] = label[k]
                        a.append(max(ids[k], ids[m]))
                        b.append(min(ids[k], ids[m]))
                rest = rest[label[rest] != label[k]]
        if not a:
            return None
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return by_group(cut, ["bucket", "i", "j"], run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, text_hash)`` for every row of ``docs(doc_id, text)``.

    Documents are linked where ``100 * intersection >= percent * union`` of their sets of
    distinct 5-word shingles; ``component_id`` is the smallest doc_id reachable by links,
    ``kept`` marks the rows whose own id that is.  Sets are compared whole, as 64-bit
    shingle hashes.  ``text_hash``, ``xxhash64`` of the text, tells rows of one id apart.

    Null and empty texts, and texts without words, have an empty set and stand alone; a
    text of one to four words is one shingle; texts of any length count whole; documents of
    equal sets are one class and never paired; repeated rows each get their row, and rows of
    one doc_id with different texts each count, by its own text; rows of null doc_id get a null component unless their class has an id, and are not kept; other
    columns are ignored; an empty table gives an empty result.
    """
    threshold = percent / 100
    scratch = Scratch(spark)
    all_ = scratch.table(sketch(docs), "sketches")
    # a class is the documents of one set; one of them stands for it, under a number of its own,
    # as one id may have several texts
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("rep")
    classes = all_.where("n_shingles > 0").groupBy("set_a", "set_b").agg(least, F.count("*").alias("times"))
    classes = classes.select("set_a", "set_b", "times", F.col("rep.doc_id").alias("rep"), F.col("rep.text_hash").alias("text_hash"))
    classes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    known = classes.where("rep is not null").select(F.col("rep").alias("doc_id"), "text_hash", "set_a", "set_b", "node")
    own = ["doc_id", "text_hash", "set_a", "set_b"]
    sketches = all_.join(known, own).dropDuplicates(["node"]).select(F.col("node").alias("doc_id"), "n_shingles", "sketch")
    sketches = scratch.table(sketches, "reps")

    width = 2 * ROWS
    bands = sketches.select("doc_id", F.posexplode(F.array(*[F.substring("sketch", k * width + 1, width) for k in range(BANDS)])).alias("band", "part"))
    bands = bands.select("doc_id", F.xxhash64("band", "part").alias("bucket"))
    buckets = bands.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    # written first: the join then has plain sides, and its memory is not that of the count
    buckets = scratch.table(buckets, "buckets")
    members = scratch.table(bands.join(buckets, "bucket").select("bucket", F.col("doc_id").alias("id"), "hub"), "members")
    in_buckets = members.select(F.col("id").alias("doc_id")).distinct()
    named = known.join(in_buckets.select(F.col("doc_id").alias("node")), "node").select("doc_id", "text_hash", "node")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    # the one shuffle of texts; the merge hint keeps it the same at every size
    texts = text.join(named.hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["node"])
    texts = scratch.table(texts.select(F.col("node").alias("doc_id"), "text"), "texts")

    # each document with the smallest hub of its buckets: one pair a document
    pairs = members.groupBy("id").agg(F.min("hub").alias("b")).where("id <> b").select(F.col("id").alias("a"), "b")
    links = _verified(_estimated(pairs, sketches, threshold), texts, percent)
    placed = scratch.table(connected_components(links, scratch, "first"), "components-0")
    for k in range(1, ROUNDS + 2):
        # buckets whose members still are in several components
        here = members.join(placed, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
        open_ = here.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("id", F.xxhash64("id", F.lit(k))).alias("other")).where("low <> high").select("bucket", "other")
        rest = scratch.table(here.join(open_, "bucket"), f"rest-{k}")
        if rest.isEmpty():
            break
        if k <= ROUNDS:  # with one member of its buckets, drawn anew each round
            other = placed.select(F.col("id").alias("other"), F.col("component").alias("theirs"))
            pairs = rest.join(other, "other", "left").where(F.coalesce("theirs", "other") != F.col("component"))
            pairs = pairs.groupBy("id").agg(F.min_by("other", F.xxhash64("bucket", F.lit(k))).alias("b")).select(F.col("id").alias("a"), "b")
            found = _verified(_estimated(pairs, sketches, threshold), texts, percent)
        else:  # with all members of other components, in blocks
            found = _block_links(rest, sketches, texts, percent)
        # components so far stand for the links found so far
        links = placed.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found)
        placed = scratch.table(connected_components(links, scratch, f"round-{k}"), f"components-{k}")

    labelled = known.join(placed.select(F.col("id").alias("node"), "component"), "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    labelled = scratch.table(labelled, "labelled")
    scratch.drop(*[n for n in scratch.paths if n not in ("sketches", "classes", "labelled")])
    # the smallest id of each component; one component may hold many of the classes
    sizes = labelled.groupBy("component").agg(F.min("doc_id").alias("low"), F.count("*").alias("times"))
    lows = spread_join(labelled.select("node", "component"), sizes.select("component", "low"), ["component"], sizes, labelled.count(), "node").select("node", "low")
    by_class = classes.join(lows, "node", "left").select("set_a", "set_b", F.col("low").alias("component"))
    # one class may hold many of the documents
    rows = all_.select("doc_id", "n_shingles", "set_a", "set_b", "text_hash")
    out = spread_join(rows.where("n_shingles > 0"), by_class, ["set_a", "set_b"], classes, rows.count(), "doc_id")
    none = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"), "text_hash")
    out = out.select("doc_id", "n_shingles", "component", "text_hash").union(none)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"), "text_hash")
