"""What the operators share: the shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests), a temporary folder is set and used.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="stopgraph-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


class Scratch:
    """Tables written to the shared folder, so that no lineage hangs on an executor.

    A lost executor costs only the tasks that it ran: every later stage reads files.
    ``drop`` removes tables that no returned DataFrame reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = shared_path(self.spark, name), df.schema
        df.write.parquet(path)
        self.paths[name] = path
        del df
        gc.collect()
        self.spark._jvm.System.gc()  # lets Spark drop the shuffle files of finished steps
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


def byte_slices(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together, or one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, order: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Stream each group of equal ``keys`` through ``fn`` as one Arrow table.

    Rows are dealt by ``keys`` and sorted; a task holds one group at a time, so callers
    keep groups at a bounded number of rows.
    """
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys, *(order or []))

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(batch.num_rows, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in columns)
            new[0] = first != last
            cuts = np.flatnonzero(new).tolist()
            begin = 0
            for cut in cuts:
                if cut > begin:
                    held.append(batch.slice(begin, cut - begin))
                if held:
                    out = fn(pa.Table.from_batches(held))
                    if out is not None and out.num_rows:
                        yield out
                held, begin = [], cut
            held.append(batch.slice(begin))
            last = tuple(c[-1] for c in columns)
        if held:
            out = fn(pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                yield out

    return dealt.mapInArrow(released(run), schema)


def released(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, with the memory that a task has freed handed back to the system.

    Workers live on for other tasks; without this each keeps the most that any of them took.
    """

    def with_release(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return with_release


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, for steps that make many rows of one."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def vectors(column: pa.Array | pa.ChunkedArray, dim: int, dtype=np.float64) -> np.ndarray:
    """Rows of a binary column as an array of ``dim`` numbers each."""
    data, _ = utf8(column)
    return data.view(dtype).reshape(-1, dim) if len(data) else np.zeros((0, dim), dtype)


def binary(rows: np.ndarray) -> pa.Array:
    """Each row of a 2-D array as one binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize if rows.ndim == 2 else 0
    off = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(rows.tobytes())])


#: Keys that a join spreads at most, and copies that each of them gets.
SPREAD, COPIES = 1000, 32


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], counts: DataFrame, total: int, by: str) -> DataFrame:
    """The inner join on ``keys``, with keys of more than a thousandth of ``many``'s rows spread.

    ``counts`` has ``times``, the rows of each key in ``many``, and ``total`` is their number,
    so there are fewer than ``SPREAD`` such keys, and only they are broadcast.  Their rows of
    ``few`` (one a key) are copied, and ``many``'s rows pick a copy by a hash of ``by``.
    """
    hot = F.broadcast(counts.where(F.col("times") * SPREAD > total).select(*keys, F.lit(COPIES).alias("__copies")))
    salt = F.when(F.col("__copies").isNotNull(), F.pmod(F.xxhash64(by), F.col("__copies"))).otherwise(0).cast("int")
    left = many.join(hot, keys, "left").withColumn("__salt", salt).drop("__copies")
    right = few.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1))).drop("__copies")
    return left.join(right.hint("merge"), [*keys, "__salt"]).drop("__salt")


def held_out(column="doc_id"):
    """The fold that labels are never learnt from: crc32(id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))
