"""Removal of long repeated byte strings by suffix sorting, over shards of any number.

Texts that are equal as a whole are one class.  In the others, every window of ``length``
bytes has an anchor: of the short grams in it the one with the smallest hash, the leftmost
of equals.  Equal windows have equal anchors at equal places, so windows are dealt to shards
by their anchor's hash, and only anchors that occur again are followed.  What a shard gets
is each anchor's region, the bytes of the windows that it owns; equal regions are counted
before the shuffle and sorted once.  A shard sorts the suffixes of its regions by recursive
induction (:mod:`.induced`), whose common-prefix values show the windows that start elsewhere
too.  Regions of an anchor that has more than a shard of them are dealt further, by the bytes
left and right of its gram, first to other tasks and then to files of a task.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_slices, mix, released, remove, shared_path, spread_join, utf8
from .induced import Files, suffix_order

#: Bytes of a gram, of text worked on at once (arrays over it fit a core's cache), and of regions sorted together.
GRAM, CHUNK, SHARD = 32, 1 << 18, 2 << 20
#: Tasks, and then files of a task, on each side that an anchor of more than a shard is dealt to.
FILES = 16
#: Bytes of tuples that a queue of the induction holds before it writes runs to files.
QUEUE = 16 << 20
#: Bytes of an anchor's regions, copies counted, from which on they are dealt to several tasks.
LARGE = 32 * SHARD
_BYTE = mix((np.arange(256).astype(np.uint64) + np.uint64(77)) * np.uint64(0x9E3779B97F4A7C15))
_ODD = 0xA0761D6478BD642F
_PLACE = (1 << 24) - 1


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the gram at each place; the last places have none and get zero."""
    n = len(data)
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * np.cumprod(up), out=sums[1:])
    out = np.zeros(n, np.uint64)
    if n >= GRAM:
        out[: n - GRAM + 1] = mix((sums[GRAM:] - sums[:-GRAM]) * np.cumprod(down)[: n - GRAM + 1])
    return out


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, hash, first window, windows, place)`` for each run of windows with one anchor, ``place`` bytes behind its first."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 5
    h = _gram_hashes(data)
    key = (h & ~np.uint64(_PLACE)) | np.arange(n).astype(np.uint64)
    low, reach = key[: n - GRAM + 1], 1
    while 2 * reach <= width:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: n - length + 1], low[width - reach : width - reach + n - length + 1])
    owner = (low & np.uint64(_PLACE)).astype(np.int64)
    size = np.diff(off)
    whole = np.repeat(np.arange(len(size)), size)[: len(owner)]
    valid = np.arange(len(owner)) + length <= off[1:][whole]
    at = np.flatnonzero(valid)
    if not len(at):
        return (at,) * 5
    first = np.r_[True, (owner[at[1:]] != owner[at[:-1]]) | (at[1:] != at[:-1] + 1)]
    begin = at[first]
    runs = np.diff(np.r_[np.flatnonzero(first), len(at)])
    doc = whole[begin]
    return doc, h[owner[begin]].view(np.int64), begin - off[doc], runs, owner[begin] - begin


def _pieces(off: np.ndarray, length: int):
    """Slices of texts for one call each: whole short texts, or windows of a long one."""
    for i, j in byte_slices(off, CHUNK):
        if off[j] - off[i] <= 2 * CHUNK:
            yield i, j, int(off[i]), int(off[j])
            continue
        for a in range(int(off[i]), int(off[j]) - length + 1, CHUNK):
            yield i, j, a, min(a + CHUNK + length - 1, int(off[j]))


def _digest():
    """The class of a text: half of its SHA-256."""
    return F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)


def repeated(spark: SparkSession, docs: DataFrame, length: int = 200) -> tuple[DataFrame, DataFrame]:
    """The distinct texts of at least ``length`` bytes, and the runs to remove from each.

    The first has ``(sha, copies, text)`` and lies in buckets of ``sha``, so joins with it
    do not shuffle texts again; the second has ``(sha, runs array<struct<begin, end>>)``
    for texts that are no copies, runs being maximal and in order.
    """
    scratch = Scratch(spark)
    whole = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    whole = whole.select(_digest().alias("sha"), "text").groupBy("sha").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    name, path = f"stopgraph_{uuid.uuid4().hex}", shared_path(spark, "texts")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "sha").saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only: files stay, and so do the buckets in this plan

    def find(batches):
        for b in batches:
            data, off = utf8(b.column(1))
            for i, j, a, z in _pieces(off, length):
                inner = np.clip(off[i : j + 1], a, z) - a
                doc, h, begin, n, place = anchors(data[a:z], inner, length)
                if len(doc):
                    begin = begin + (a - off[i] if j == i + 1 else 0)
                    yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(pa.array(doc + i)), pa.array(begin.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], ["anchor", "sha", "begin", "n", "place"])

    found = scratch.table(texts.select("sha", "text").mapInArrow(released(find), "anchor long, sha binary, begin int, n int, place int"), "anchors")
    times = found.groupBy("anchor").agg(F.count("*").alias("times"), F.sum(F.col("n").cast("long") + length - 1).alias("bytes")).where("times > 1")
    times = scratch.table(times, "times")
    again = times.select("anchor", (F.col("bytes") > LARGE).alias("large"))
    followed = spread_join(found, again, ["anchor"], times, found.count(), "sha").groupBy("sha").agg(F.collect_list(F.struct("anchor", "begin", "n", "place", "large")).alias("runs"))

    def cut(batches):
        for b in batches:
            data, off = utf8(b.column(1))
            flat = b.column(2).flatten()
            anchor, begin, n, place, large = (c.to_numpy(zero_copy_only=False) for c in flat.flatten())
            size = np.diff(np.asarray(b.column(2).offsets))
            owner = np.repeat(np.arange(b.num_rows), size)
            for a, z in byte_slices(np.r_[0, np.cumsum(n + length - 1)], CHUNK):
                start = off[owner[a:z]] + begin[a:z]
                regions = [data[s : s + k].tobytes() for s, k in zip(start.tolist(), (n[a:z] + length - 1).tolist(), strict=True)]
                marks = [hashlib.blake2b(r, digest_size=16).digest() for r in regions]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[a:z]), pa.array(marks, pa.binary()), b.column(0).take(pa.array(owner[a:z])), pa.array(begin[a:z]), pa.array(n[a:z]), pa.array(place[a:z]), pa.array(large[a:z]), pa.array(regions, pa.binary())], ["anchor", "mark", "sha", "begin", "n", "place", "large", "region"])

    regions = texts.select("sha", "text").join(followed, "sha").mapInArrow(released(cut), "anchor long, mark binary, sha binary, begin int, n int, place int, large boolean, region binary")
    regions = scratch.table(regions, "regions")
    scratch.drop("anchors", "times")
    distinct = regions.groupBy("anchor", "mark").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.first("place").alias("place"), F.first("large").alias("large"), F.first("region").alias("region"))
    files = shared_path(spark, "spill")
    found_again = scratch.table(_sorted_shards(distinct, length, files), "hits")
    remove(spark, files)
    # a dealt region comes back in parts
    found_again = found_again.groupBy("anchor", "mark").agg(F.collect_list("windows").alias("windows"))
    copies = regions.groupBy("anchor", "mark").agg(F.count("*").alias("times"))
    hits = spread_join(regions.select("anchor", "mark", "sha", "begin"), found_again, ["anchor", "mark"], copies, regions.count(), "sha").select("sha", "begin", "windows")
    runs = hits.groupBy("sha").agg(F.collect_list(F.struct("begin", "windows")).alias("hits"))

    def union(batches):
        for b in batches:
            for rows in _joined(b.column(1), length):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(rows[0], len(rows[1])), rows[1]], ["sha", "runs"])

    out = scratch.table(runs.mapInArrow(union, "sha binary, runs array<struct<begin: long, end: long>>"), "runs")
    scratch.drop("regions", "hits")
    return texts, out


def _joined(column: pa.Array, length: int):
    """``(first row, runs of the rows from it on)``: the maximal runs that each row's windows cover."""
    off = np.asarray(column.offsets).astype(np.int64)
    hits = column.flatten()
    begin, windows = hits.field("begin").to_numpy(), hits.field("windows")
    parts = np.asarray(windows.offsets).astype(np.int64)
    data, at = utf8(windows.flatten())
    off, parts = off - off[0], parts - parts[0]
    for i, j in byte_slices(at[parts[off]], CHUNK):
        a, z = parts[off[i]], parts[off[j]]
        size = np.diff(at[a : z + 1]) >> 2
        hit = np.repeat(np.arange(off[i], off[j]), np.diff(parts[off[i] : off[j] + 1]))
        row = np.repeat(np.arange(j - i), np.diff(off[i : j + 1]))[hit - off[i]]
        start = (row << 32) + begin[hit]
        place = np.sort(np.frombuffer(data[at[a] : at[z]].tobytes(), np.int32) + np.repeat(start, size))
        # another row is more than any length away
        edge = np.flatnonzero(place[1:] > place[:-1] + length)
        first, last = place[np.r_[0, edge + 1]], place[np.r_[edge, len(place) - 1]]
        cuts = np.searchsorted(first, np.arange(j - i + 1) << 32).astype(np.int32)
        low = np.int64((1 << 32) - 1)
        runs = pa.StructArray.from_arrays([pa.array(first & low), pa.array((last & low) + length)], ["begin", "end"])
        yield i, pa.ListArray.from_arrays(pa.array(cuts), runs)


PIECE = "anchor long, part int, mark binary, times long, first int, place int, n int, region binary"


def _sorted_shards(distinct: DataFrame, length: int, folder: str) -> DataFrame:
    """``(anchor, mark, windows)``: the windows of each region that start elsewhere too."""
    limit, queue = SHARD, QUEUE

    def deal(batches):
        for b in batches:
            out = []
            for anchor, mark, times, n, place, large, region in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if not large:
                    out.append((anchor, -1, mark, times, 0, place, n, region))
                    continue
                for side, key, first, at, cut, body in _sides(region, 0, place, n, 0, 0, length):
                    out.append((anchor, side * FILES + _file(key, 0), mark, times, first, at, cut, body))
                if len(out) > 4096:
                    yield _pieces_batch(out)
                    out = []
            if out:
                yield _pieces_batch(out)

    pieces = distinct.select("anchor", "mark", "times", "n", "place", "large", "region").mapInArrow(released(deal), PIECE)
    dealt = pieces.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "mark")
    return dealt.mapInArrow(released(lambda batches: _shards(batches, length, limit, Files(folder), queue)), "anchor long, mark binary, windows binary")


def _pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in PIECE.split(", ")])


def _shards(batches, length: int, limit: int, files: Files, queue: int):
    """Sort runs of whole anchors, or parts of one; more than ``limit`` bytes of one are dealt to files."""
    held, size, own, last, hot = [], 0, 0, None, None
    for b in batches:
        for anchor, part, *row in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
            row = ((anchor, part), *row)
            if row[0] != last:
                if hot is not None:
                    yield from _found((last[0], *hit) for hit in _hot(hot, last[1], length, limit, files, queue))
                    hot = None
                if size >= limit:
                    yield from _windows(held, length, files, queue)
                    held, size = [], 0
                last, own = row[0], 0
            own += len(row[6])
            if hot is None:
                held.append(row)
                size += len(row[6])
                if own > limit:
                    yield from _windows([r for r in held if r[0] != last], length, files, queue)
                    hot = _Spool(files)
                    for r in held:
                        if r[0] == last:
                            hot.add(*r[1:])
                    held, size = [], 0
            else:
                hot.add(*row[1:])
    if hot is not None:
        yield from _found((last[0], *hit) for hit in _hot(hot, last[1], length, limit, files, queue))
    if held:
        yield from _windows(held, length, files, queue)


class _Spool:
    """Pieces of regions in a file: mark, times, first window, place of the gram, windows, bytes."""

    HEAD = struct.Struct("<16sqiiii")

    def __init__(self, files: Files):
        self.files, self.bytes, self.rows = files, 0, 0
        self.path, self.stream = files.open()

    def add(self, mark: bytes, times: int, first: int, place: int, n: int, body: bytes) -> None:
        self.stream.write(self.HEAD.pack(mark, times, first, place, n, len(body)) + body)
        self.bytes += len(body)
        self.rows += 1

    def __iter__(self):
        if not self.stream.closed:
            self.stream.close()
        with self.files.read(self.path) as stream:
            while head := stream.read(self.HEAD.size):
                *rest, size = self.HEAD.unpack(head)
                yield (*rest, stream.read(size))

    def remove(self) -> None:
        if not self.stream.closed:
            self.stream.close()
        self.files.remove(self.path)


def _span(left: int, right: int, length: int) -> tuple[int, int, int]:
    """Bytes of a window still unknown, and how many of them each side is dealt by."""
    span = length - GRAM - left - right
    half = (span + 1) // 2
    return span, half, length - GRAM - left - half + (span > 0)


def _sides(body: bytes, first: int, place: int, n: int, left: int, right: int, length: int):
    """``(side, key, first, place, n, bytes)``: a piece cut in windows dealt by what is left of the gram, and right of it.

    All windows hold ``left`` bytes before the gram and ``right`` bytes after it.  Each holds
    half of the other bytes before or after those, too; equal windows are dealt alike.
    """
    _, half, more = _span(left, right, length)
    cut = min(max(place - left - half + 1, 0), n)
    if cut:
        yield 0, body[place - left - half : place + GRAM + right], first, place, cut, body[: cut + length - 1]
    if cut < n:
        yield 1, body[place - left : place + GRAM + more], first + cut, place - cut, n - cut, body[cut:]


def _alike(rows: list[tuple], length: int) -> list[tuple]:
    """The pieces that share with another one of their group the bytes that two rounds of dealing look at.

    Equal windows are dealt alike, so a piece that is alone wherever it goes holds no window
    of another one.
    """
    if not rows:
        return rows
    _, half, more = _span(0, 0, length)
    goes, met = [], {}
    for group, _, _, _, place, n, body in rows:
        own = []
        for side, key, _, at, cut, part in _sides(body, 0, place, n, 0, 0, length) if group[1] < 0 else [(None, None, 0, place, n, body)]:
            left, right = ((half, 0) if side == 0 else (0, more)) if side is not None else ((half, 0) if group[1] < FILES else (0, more))
            own += [hash((group, side, left, further, key2)) for further, key2, *_ in _sides(part, 0, at, cut, left, right, length)]
        goes.append(own)
        for k in set(own):
            met[k] = met.get(k, 0) + 1
    return [r for r, own in zip(rows, goes, strict=True) if any(met[k] > 1 for k in own)]


def _file(key: bytes, depth: int) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8, salt=depth.to_bytes(4, "little")).digest(), "little") % FILES


def _hot(pieces: _Spool, part: int, length: int, limit: int, files: Files, queue: int):
    """``(mark, windows)`` of an anchor's regions, or of one part of them dealt before."""
    for mark, times, first, _, n, _ in pieces:
        if times > 1:
            yield mark, np.arange(first, first + n, dtype=np.int32)
    if part < 0:
        yield from _dealt(pieces, 0, 0, length, limit, 0, files, queue)
    else:
        _, half, more = _span(0, 0, length)
        yield from _dealt(pieces, *((half, 0) if part < FILES else (0, more)), length, limit, 1, files, queue)


def _dealt(pieces: _Spool, left: int, right: int, length: int, limit: int, depth: int, files: Files, queue: int):
    """Windows of pieces that stand once each, dealt to files until each file can be sorted.

    Where nothing is left to deal by, a window is compared as a whole.
    """
    span, half, more = _span(left, right, length)
    sides = [[None] * FILES, [None] * FILES]
    whole, same = None, 0
    for mark, times, first, place, n, body in pieces:
        if not span:
            whole = body if whole is None else whole
            if body == whole:
                same += 1
                continue
        for side, key, *piece in _sides(body, first, place, n, left, right, length):
            k = _file(key, depth)
            if sides[side][k] is None:
                sides[side][k] = _Spool(files)
            sides[side][k].add(mark, times, *piece)
    if same > 1:
        for mark, times, first, _, _, body in pieces:
            if times == 1 and body == whole:
                yield mark, np.array([first], np.int32)
    pieces.remove()
    for side, (a, z) in zip(sides, ((left + half, right), (left, more)), strict=True):
        for part in side:
            if part is None:
                continue
            if part.rows > 1 and part.bytes > limit:
                yield from _dealt(part, a, z, length, limit, depth + 1, files, queue)
                continue
            if part.rows > 1:
                rows = list(part)
                flag, at = _repeats([r[5] for r in rows], length, files, queue), 0
                for mark, times, first, _, n, body in rows:
                    hit = np.flatnonzero(flag[at : at + n])
                    if times == 1 and len(hit):
                        yield mark, (hit + first).astype(np.int32)
                    at += len(body) + 1
            part.remove()


def _repeats(regions: list[bytes], length: int, files: Files | None = None, queue: int = QUEUE) -> np.ndarray:
    """True where ``length`` bytes start that start elsewhere too; each region has one place more."""
    # 1 ends each region; bytes 0 and 1 become two that no region holds, so lengths stay
    body = np.frombuffer(b"\x00".join(regions) + b"\x00", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in regions]) - 1
    times_of = np.bincount(body, minlength=256)
    text = body.copy()
    if times_of[0] > len(ends) or times_of[1]:
        free = np.flatnonzero(times_of[2:] == 0)[-2:] + 2
        if len(free) < 2:
            raise ValueError("texts that are not UTF-8")
        text[body == 0], text[body == 1] = free
    text[ends] = 1
    order, shared = suffix_order(text, length, queue, files)
    near = shared >= length
    flag = np.zeros(len(text), bool)
    flag[order[near]] = True
    flag[order[np.flatnonzero(near) - 1]] = True
    return flag


def _windows(rows: list[tuple], length: int, files: Files, queue: int):
    """Sort the regions of a shard and report windows shared with another place."""
    alone: dict[tuple, int] = {}
    for group, *_ in rows:
        alone[group] = alone.get(group, 0) + 1
    out = [(group[0], mark, np.arange(first, first + n, dtype=np.int32)) for group, mark, times, first, _, n, _ in rows if times > 1]
    # a group of one piece has nothing to sort, nor has one that shares too little with the others
    sort = _alike([r for r in rows if alone[r[0]] > 1], length)
    if sort:
        flag, at = _repeats([r[6] for r in sort], length, files, queue), 0
        for group, mark, times, first, _, n, region in sort:
            if times == 1:
                hit = np.flatnonzero(flag[at : at + n]).astype(np.int32)
                if len(hit):
                    out.append((group[0], mark, hit + np.int32(first)))
            at += len(region) + 1
    yield from _found(out)


def _found(hits):
    """Batches of ``(anchor, mark, windows)``."""
    hits = iter(hits)
    while out := list(islice(hits, 8192)):
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2].tobytes() for o in out], pa.binary())], ["anchor", "mark", "windows"])


def _cut(text: bytes, runs: list[dict]) -> bytes:
    parts, at = [], 0
    for r in runs:
        parts.append(text[at : r["begin"]])
        at = r["end"]
    return b"".join([*parts, text[at:]])


def report(spark: SparkSession, docs: DataFrame, length: int = 200) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for each row of ``docs``.

    Every byte covered by a ``length``-byte string that also starts elsewhere, in the same
    or another text, is removed; texts are judged as given.  A null text is empty; texts
    shorter than ``length`` stay; rows with equal texts of at least ``length`` bytes lose
    them whole; repeated rows are such copies; ids may be null or repeat; other columns are
    ignored; an empty table gives an empty result.
    """
    texts, runs = repeated(spark, docs, length)

    def digest(batches):
        for b in batches:
            data, off = utf8(b.column(1))
            removed, spans, kept = [], [], []
            for k, row in enumerate(b.column(2).to_pylist()):
                removed.append(sum(r["end"] - r["begin"] for r in row))
                spans.append(len(row))
                kept.append(hashlib.sha256(_cut(data[off[k] : off[k + 1]].tobytes(), row)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], ["sha", "n_removed", "n_spans", "kept"])

    some = texts.where("copies = 1").select("sha", "text").join(runs, "sha").mapInArrow(digest, "sha binary, n_removed long, n_spans long, kept string")
    all_ = texts.where("copies > 1").select("sha", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("own")).withColumn("sha", F.substring(F.unhex("own"), 1, 16))
    zero = F.lit(0).cast("long")
    return rows.join(some.unionByName(all_), "sha", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "own").alias("kept_sha256"))


def removed(spark: SparkSession, docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; bytes left over from a character go too."""
    texts, runs = repeated(spark, docs, length)
    marks = texts.where("copies > 1").select("sha", F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.octet_length("text").cast("long").alias("end"))).alias("runs")).unionByName(runs.join(texts.where("copies > 1").select("sha"), "sha", "left_anti"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)
    both = docs.withColumn("__sha", sha).join(marks.withColumnsRenamed({"sha": "__sha", "runs": "__runs"}), "__sha", "left").drop("__sha")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        for b in batches:
            at, runs_at = b.schema.get_field_index("text"), b.schema.get_field_index("__runs")
            column, cuts = b.column(at), b.column(runs_at)
            if cuts.null_count < len(cuts):
                new = [t.as_py() if r is None else _cut((t.as_py() or "").encode(), r).decode("utf-8", "ignore") for t, r in zip(column, cuts.to_pylist(), strict=True)]
                column = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([column if k == at else b.column(k) for k in range(b.num_columns) if k != runs_at], [n for k, n in enumerate(b.schema.names) if k != runs_at])

    return both.select(*docs.columns, "__runs").mapInArrow(run, schema)
