"""Exact top-k by inner product over a pivot-distance index.

Integer vectors are lifted by one coordinate, so that the largest inner product is the
smallest distance: a vector v becomes (v, sqrt(M - |v|^2)) with M the largest squared norm,
a query becomes (q, 0), and then |q' - v'|^2 = |q|^2 + M - 2 q.v.  Vectors are keyed by
their nearest pivot and their distance to it, in annuli sorted by that distance.  A query
first searches the annulus that it falls into itself, which gives it a bound, and then
expands over the annuli next to it, more of them each time, with the bound drawn tighter
after each expansion, until the triangle inequality shows that no vector further out can
reach the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import block_join
from .common import Scratch, binary, small, vectors

#: Pivots, and annuli of each: the index's directory has their product of rows at most.
PIVOTS, BANDS = 16, 8
#: Vectors that pivots are chosen from, and rows of a block.
SAMPLE, BLOCK = 4096, 2048
#: Annuli that a query has seen after each expansion but the last one, which sees all within its bound.
STEPS = (1, 6, 24)
#: Relative slack of distances, far above their rounding.
SLACK = 1e-6


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``(id, v array<double>, copies long, norm double)`` of floor(scale * x), whole vectors only.

    A vector that is null, empty, or holds null or non-finite components takes no part, nor
    does a row of null id.  Rows with equal ids and vectors are one row with ``copies``.
    """
    v = F.col(vec_col).cast("array<double>")
    sound = F.size(v) > 0
    sound &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))
    whole = whole.groupBy("id", "v").agg(F.count("*").alias("copies"))
    return whole.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def _pack(rows: DataFrame, dim: int) -> DataFrame:
    """Vectors as binaries of ``dim`` doubles; shorter ones end in zeros."""

    def run(batches):
        for b in batches:
            out = np.zeros((b.num_rows, dim))
            lists = b.column(1)
            off, values = np.asarray(lists.offsets), np.asarray(lists.values)
            for k in range(b.num_rows):
                out[k, : off[k + 1] - off[k]] = values[off[k] : off[k + 1]]
            yield pa.RecordBatch.from_arrays([b.column(0), binary(out), *(b.column(k) for k in range(2, 5))], ["id", "v", "norm", "row", "copies"])

    return rows.select("id", "v", "norm", "row", "copies").mapInArrow(run, "id long, v binary, norm double, row long, copies long")


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors far from each other: each next one is the furthest from those chosen."""
    chosen = [sample[0]]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(sample[int(gap.argmax())])
        gap = np.minimum(gap, ((sample - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _lift(v: np.ndarray, norm: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(most - norm, 0))[:, None]], 1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def _floats(bound) -> np.ndarray:
    """Bounds as floats just below the integers, NaN where there is none."""
    x = bound.to_numpy(zero_copy_only=False).astype(np.float64)
    return x - np.maximum(0.25, np.abs(x) * 1e-15)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floats only while every partial sum stays exact."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if bound < 1 << 24:
        return (q.astype(np.float32) @ v.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (q @ v.T).astype(np.int64)
    return np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in v] for x in q], dtype=object)


def top_k(spark: SparkSession, rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of each query.

    ``is_query`` is a condition on column ``id``; the candidates of a query are all rows but
    its own.  Ties go to the smaller id; with fewer candidates than ``k`` all are returned.
    Rows that repeat an id are rows like others: each is a candidate, also of the others with
    its id, and each that is a query has its own ``k`` results, under the same id.
    See :func:`integer_vectors` for nulls.  Vectors of different lengths
    count as ended by zeros; scores beyond 64 bits are cut to that range.  Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark)
    whole = scratch.table(integer_vectors(rows, id_col, vec_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, dim, most = whole.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    packed = _pack(whole, dim)
    sample = np.array([np.pad(np.array(r.v), (0, dim - len(r.v))) for r in whole.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()])
    pivots = _pivots(_lift(sample, (sample**2).sum(1), most), PIVOTS)
    width = max(float(_distances(_lift(sample, (sample**2).sum(1), most), pivots).min(1).max()) / BANDS, 1e-9)

    def key(batches):
        for b in batches:
            v, norm = vectors(b.column(1), dim), b.column(2).to_numpy()
            d = _distances(_lift(v, norm, most), pivots)
            near = d.argmin(1)
            own = d[np.arange(len(d)), near]
            band = np.minimum(own / width, BANDS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array((near * BANDS + band).astype(np.int32)), b.column(0), b.column(1), pa.array(own), pa.nulls(len(d), pa.int64()), b.column(3), b.column(4)], names)

    kind = "cell int, id long, v binary, at double, bound long, row long, copies long"
    names = [c.split()[0] for c in kind.split(", ")]
    index = scratch.table(packed.mapInArrow(key, kind), "index")
    rings = {r.cell: (r.low, r.high) for r in index.groupBy("cell").agg(F.min("at").alias("low"), F.max("at").alias("high")).collect()}
    cells = np.array(sorted(rings), np.int64)
    low, high = np.array([rings[c][0] for c in cells]), np.array([rings[c][1] for c in cells])

    def search(data: pa.Table, queries: pa.Table):
        """The best k of a block for each query, as far as they reach the query's bound."""
        at = data.column("at").to_numpy()
        order = np.argsort(at, kind="stable")
        ids, numbers, copies = (data.column(c).to_numpy()[order] for c in ("id", "row", "copies"))
        at, v = at[order], vectors(data.column("v"), dim)[order]
        q, own = vectors(queries.column("v"), dim), queries.column("row").to_numpy()
        bound = _floats(queries.column("bound"))
        # the window of distances to the pivot in which the bound can be reached
        reach = np.where(np.isnan(bound), np.inf, np.sqrt(np.maximum((q**2).sum(1) + most - 2 * np.nan_to_num(bound), 0)))
        away, slack = queries.column("at").to_numpy(), SLACK * (1 + np.sqrt(most))
        begin = np.searchsorted(at, away - reach - slack, "left")
        end = np.searchsorted(at, away + reach + slack, "right")
        some = np.flatnonzero(begin < end)
        if not len(some):
            return None
        a, z = int(begin[some].min()), int(end[some].max())
        score = _scores(q[some], v[a:z])
        inside = (np.arange(a, z)[None] >= begin[some][:, None]) & (np.arange(a, z)[None] < end[some][:, None])
        # of a row that stands several times, a query's own one does not count
        times = copies[a:z][None] - (numbers[a:z][None] == own[some][:, None])
        inside &= times > 0
        inside &= ~(score < np.where(np.isnan(bound), -np.inf, bound)[some][:, None])
        of, out_v, out_s = [], [], []
        for r in range(len(some)):
            got = np.flatnonzero(inside[r])
            if len(got) > k:
                got = got[np.lexsort((ids[a:z][got], -score[r][got]))[:k]]
            got = np.repeat(got, np.minimum(times[r][got], k))
            of.append(np.full(len(got), some[r]))
            out_v.append(ids[a:z][got])
            out_s.append(score[r][got])
        out_s = [min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in np.concatenate(out_s)] if score.dtype == object else np.concatenate(out_s)
        asks = pa.array(np.concatenate(of))
        return pa.RecordBatch.from_arrays([*(queries.column(c).combine_chunks().take(asks) for c in ("row", "id", "copies")), pa.array(np.concatenate(out_v)), pa.array(out_s, pa.int64())], [c.split()[0] for c in found.split(", ")])

    def best(found: DataFrame) -> DataFrame:
        ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    found = "query long, query_id long, times long, vec_id long, score long"
    asked = index.where(is_query)

    def expand(first: int, last: int | None):
        """Of the annuli next to each query, those from the ``first`` to before the ``last`` that can reach its bound."""

        def run(batches):
            for b in small(batches):
                v = vectors(b.column(2), dim)
                d = _distances(np.concatenate([v, np.zeros((len(v), 1))], 1), pivots)[:, cells // BANDS]
                bound = _floats(b.column(4))
                reach = np.where(np.isnan(bound), np.inf, np.sqrt(np.maximum((v**2).sum(1) + most - 2 * np.nan_to_num(bound), 0)))
                gap = np.maximum(np.maximum(low[None] - d, d - high[None]), 0)
                turn = np.empty(gap.shape, np.int64)  # a query's home comes first: no gap, and its pivot is near
                np.put_along_axis(turn, np.argsort(gap + 1e-12 * d, axis=1, kind="stable"), np.arange(len(cells))[None], 1)
                near = gap <= reach[:, None] + SLACK * (1 + np.sqrt(most))
                row, ring = np.nonzero(near & (turn >= first) & (turn < (len(cells) if last is None else last)))
                if len(row):
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(cells[ring].astype(np.int32)), b.column(1).take(take), b.column(2).take(take), pa.array(d[row, ring]), *(b.column(c).take(take) for c in (4, 5, 6))], b.schema.names)

        return run

    got, bounded = None, asked
    for first, last in zip((0, *STEPS), (*STEPS, None), strict=True):
        new = block_join(index, bounded.mapInArrow(expand(first, last), kind), search, found, BLOCK, "row")
        got = best(new if got is None else got.select(*[c.split()[0] for c in found.split(", ")]).union(new))
        if last is None or last >= len(cells):
            break
        got = scratch.table(got, f"found-{last}")
        # a query's bound is its k-th score so far; with fewer scores it has none
        bounds = got.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("least"))
        bounded = asked.drop("bound").join(bounds.withColumnRenamed("least", "bound"), "row", "left").select(*names)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return got.withColumn("each", each).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
