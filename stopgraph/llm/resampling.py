"""Importance resampling towards a target distribution, by an external sort-count of hashed words.

Features are runs of words, hashed into buckets.  Documents become blocks of packed uint16
bucket streams with the documents' offsets in them, written to the shared folder.  A block is
sorted and run-length encoded for its counts, which Spark adds up; a bucket's gain is the
logarithm of how much commoner it is in the target than in the corpus.  The streams are then
read again, gains are gathered by bucket and added up by document, and the documents with the
highest gains plus Gumbel noise are drawn, in order.

Texts are read once; what is written is two bytes a feature.  A block holds some million
features (or one longer document), and a text is hashed piece by piece.  Only the gains, one
number a bucket, go through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, released, utf8

#: Features of a block, about, and bytes of text hashed at once.
BLOCK, PIECE = 1 << 20, 1 << 20

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True
#: Bytes in lower case, those of no word as spaces.
_PLAIN = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if _WORD[c + 32 if 0x41 <= c <= 0x5A else c] else 0x20 for c in range(256))


def text_words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists, each of about a piece of it; a longer word is whole."""
    begin, n = 0, len(text)
    while begin < n:
        end = min(begin + PIECE, n)
        while end < n and _WORD[_PLAIN[text[end]]]:
            end += 1
        yield text[begin:end].translate(_PLAIN).split()
        begin = end


def text_buckets(text: bytes, longest: int, buckets: int) -> tuple[np.ndarray, int]:
    """Buckets of all runs of 1 to ``longest`` words, and the number of words."""
    parts, n_words, tail = [], 0, []
    for words in text_words(text):
        n_words += len(words)
        parts.append(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets)
        if longest > 1:
            held = tail + words
            for n in range(2, longest + 1):
                first = max(0, len(tail) - n + 1)  # runs that end among the new words
                runs = [b" ".join(held[i : i + n]) for i in range(first, len(held) - n + 1)]
                parts.append(np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % buckets)
            tail = held[-(longest - 1) :]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)).astype(np.uint16), n_words


def streams(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``docs(doc_id, text)`` as blocks ``(ids, n_words, ends, stream)``: where each document's features end."""

    def run(batches):
        ids, words, ends, parts, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            stream = (np.concatenate(parts) if parts else np.zeros(0, np.uint16)).astype("<u2").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([stream], pa.binary())], ["ids", "n_words", "ends", "stream"])

        for batch in batches:
            data, off = utf8(batch.column(1))
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                own, n = text_buckets(data[off[k] : off[k + 1]].tobytes(), longest, buckets)
                if ids and size + len(own) > BLOCK:
                    yield block()
                    ids, words, ends, parts, size = [], [], [], [], 0
                size += len(own)
                ids.append(doc_id)
                words.append(n)
                ends.append(size)
                parts.append(own)
        if ids:
            yield block()

    return docs.mapInArrow(released(run), "ids array<bigint>, n_words array<bigint>, ends array<bigint>, stream binary")


def counts(blocks: DataFrame) -> DataFrame:
    """``(bucket, n)`` over all blocks: each is sorted and its runs of equal buckets counted."""

    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                stream = np.sort(np.frombuffer(value.as_buffer(), "<u2"), kind="stable")
                if len(stream):
                    first = np.flatnonzero(np.concatenate([[True], stream[1:] != stream[:-1]]))
                    runs = np.diff(np.append(first, len(stream)))
                    yield pa.RecordBatch.from_arrays([pa.array(stream[first].astype(np.int32)), pa.array(runs.astype(np.int64))], ["bucket", "n"])

    return blocks.select("stream").mapInArrow(released(run), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """A bucket's gain in thousandths: one number each, so the array's size is a parameter."""
    found = {}
    for name, df in (("s", corpus), ("t", target)):
        column = np.zeros(buckets, np.float64)
        rows = df.collect()  # a row a bucket at most
        column[[r.bucket for r in rows]] = [r.n for r in rows]
        found[name] = (column, float(sum(r.n for r in rows)))
    (s, S), (t, T) = found["s"], found["t"]
    return np.floor(1000 * np.log((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``: the floored mean of each document's gains, 0 without any."""

    def run(batches):
        for batch in batches:
            for ids, words, ends, value in zip(*(batch.column(k) for k in range(4)), strict=True):
                ids, words, ends = ids.values, words.values, ends.values.to_numpy(zero_copy_only=False).astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                n = ends - begins
                own = gain[np.frombuffer(value.as_buffer(), "<u2")]
                full = np.flatnonzero(n)
                total = np.zeros(len(n), np.int64)
                if len(full):
                    total[full] = np.add.reduceat(own, begins[full])
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.select("ids", "n_words", "ends", "stream").mapInArrow(released(run), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noisy(rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``score``: the weight plus Gumbel noise drawn by a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def drawn(scratch: Scratch, rows: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``rows(doc_id, n_words, score, ...)`` with ``rank``: 1, 2, ... for the drawn, null for the rest.

    Scores are whole numbers of a bounded range, so a count of each one finds the least that is
    drawn; only rows from there on are put in order, by ranges of score and id, and numbered
    within their range after those of the ranges before.  A score or an id that many rows share
    is split like any other range.
    """
    may = rows.where(F.col("n_words") >= min_words)
    by_score = scratch.table(may.groupBy("score").agg(F.count("*").alias("n")), "scores")
    quota = int(by_score.agg(F.sum("n")).first()[0] or 0) * percent // 100
    if quota == 0:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    coarse = by_score.groupBy(F.floor(F.col("score") / 1024).alias("slab")).agg(F.sum("n").alias("slab_n"))
    above = F.sum("slab_n").over(Window.orderBy(F.desc("slab")).rowsBetween(Window.unboundedPreceding, -1))  # a row for each 1,024 scores
    coarse = coarse.withColumn("above", F.coalesce(above, F.lit(0)))
    edge = coarse.where(f"above < {quota} and above + slab_n >= {quota}").first()
    in_slab = by_score.where(F.floor(F.col("score") / 1024) == edge.slab)
    upto = F.sum("n").over(Window.orderBy(F.desc("score")))  # 1,024 rows at most
    least = in_slab.withColumn("upto", upto + edge.above).where(F.col("upto") >= quota).agg(F.max("score")).first()[0]

    high = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__tie")]
    top = rows.where(high).withColumn("__tie", F.xxhash64("n_words", "weight", F.monotonically_increasing_id()))
    # written where they are first: the ranges are sampled from a table that does not change
    top = scratch.table(top, "candidates").repartitionByRange(*order).sortWithinPartitions(*order)
    top = top.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}).drop("__tie")
    top = scratch.table(top, "ordered")
    sizes = top.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a partition
    start = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", start.alias("__start"))
    rank = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = top.join(F.broadcast(sizes), "__part").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    return rows.where(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked.drop("__part", "__at", "__start"))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10000, percent: int = 10, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` for each row of ``docs(doc_id, text)``.

    The ``percent`` of the documents of ``min_words`` words or more with the highest scores are
    drawn and ranked, ties to the smaller id, a null id last.  Texts of ``target`` stand for the
    distribution to draw towards.  Null and empty texts have no features and weight 0; rows
    that repeat an id are scored and drawn each on its own; without any document or target text
    the result is empty, or every gain is that of an empty target; columns besides the two named
    are not read, so their names do not matter.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbers of 16 bits")
    scratch = Scratch(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = scratch.table(streams(own, longest, buckets), "streams")
    other = target.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(counts(blocks), counts(streams(other, longest, buckets)), buckets)
    rows = scratch.table(noisy(weights(blocks, gain), seed), "weights")
    scratch.drop("streams")
    return drawn(scratch, rows, percent, min_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
