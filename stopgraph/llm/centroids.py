"""Clustering around centroids in whole numbers, on distinct vectors with their multiplicities.

Components become whole numbers, equal vectors one row with its number of copies.  A round
assigns each distinct vector to its nearest centroid and adds up vectors times copies, exactly;
a task returns one sum a cluster, so copies cost nothing and no cluster is gathered.  In the
end each vector's assignment is joined back to all ids that share it; vectors of many copies
are spread in that join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, released, spread_join

#: Components up to which products and sums of squares are exact in doubles; beyond, Python's
#: whole numbers are used.  The largest long.
EXACT, MOST = 1 << 21, (1 << 63) - 1


def quantised(vectors: DataFrame, dim: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, q)``: ``floor(scale * x)`` of vectors of ``dim`` finite components; the others are left out.

    A component beyond a long is the largest or smallest long.
    """
    x = F.col(vec_col).cast("array<double>")
    whole = F.size(x) == dim
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    least, most = F.lit(-float(1 << 63)), F.lit(float(1 << 63))
    as_long = lambda v: F.when(v >= most, MOST).when(v <= least, -MOST - 1).otherwise(F.floor(v).cast("long"))
    kept = vectors.where(x.isNotNull()).where(whole).where(F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(x, lambda v: as_long(v * scale)).alias("q"))


def seeds(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors whose ids hash lowest, in that order; a null id is hashed as an empty one."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [r.q for r in rows.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()]


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray | list[int]]:
    """Each row's nearest centroid, the first of equally near ones, and the squared distance, exactly."""
    c = np.array(centroids, dtype=object)
    if len(x) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    biggest = max(-int(x.min()), int(x.max()), *(abs(int(v)) for v in c.ravel()))
    if 4 * x.shape[1] * biggest * biggest < 1 << 53:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        d = (xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None, :]
        best = d.argmin(1)
        return best, d[np.arange(len(x)), best].astype(np.int64)
    best, found = np.zeros(len(x), np.int64), []
    for i, row in enumerate(x.astype(object)):
        d = [int(((row - own) ** 2).sum()) for own in c]
        best[i] = d.index(min(d))
        found.append(min(d))
    return best, found


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(distinct: DataFrame, centroids: list[list[int]], dim: int) -> dict[int, tuple[int, list[int]]]:
    """Copies and sums of vectors times copies of each cluster: a row a cluster and component goes to the driver."""

    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            x, copies = _matrix(batch.column(0), dim), batch.column(1).to_numpy()
            best, _ = nearest(x, centroids)
            small = len(x) and max(-int(x.min()), int(x.max())) * int(copies.sum()) < 1 << 62
            for k in np.unique(best).tolist():
                own = best == k
                part = copies[own] @ x[own] if small else (copies[own].astype(object)[:, None] * x[own].astype(object)).sum(0)
                held = total.setdefault(k, [0, [0] * dim])
                held[0] += int(copies[own].sum())
                held[1] = [a + int(b) for a, b in zip(held[1], part, strict=True)]
        rows = [(k, j, str(n), str(v)) for k, (n, sums) in total.items() for j, v in enumerate(sums)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["cluster", "at", "n", "total"])

    parts = distinct.select("q", "copies").mapInArrow(released(run), "cluster bigint, at bigint, n string, total string")
    wide = parts.groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in wide.collect():  # clusters times components
        out.setdefault(int(r.cluster), (int(r.n), [0] * dim))[1][int(r["at"])] = int(r.total)
    return out


def _assigned(distinct: DataFrame, centroids: list[list[int]], dim: int) -> DataFrame:
    """``distinct`` with ``cluster`` and ``distance``; a distance beyond a long is the largest long."""

    def run(batches):
        for batch in batches:
            best, d = nearest(_matrix(batch.column(0), dim), centroids)
            far = pa.array([min(int(v), MOST) for v in d], pa.int64()) if isinstance(d, list) else pa.array(d)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), far], [*batch.schema.names, "cluster", "distance"])

    return distinct.select("q", "copies").mapInArrow(released(run), "q array<bigint>, copies bigint, cluster int, distance bigint")


def _hashes(q: str = "q") -> list[Column]:
    return [F.xxhash64(q).alias("h1"), F.xxhash64(F.lit(1), F.col(q)).alias("h2")]


def cluster(spark: SparkSession, vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, copies)`` for each vector kept.

    Vectors of another length than ``dim``, null ones and those with null or non-finite
    components are left out; of fewer vectors than ``k`` each is a centroid, equal ones too.
    Rows that repeat an id are vectors like others, a null id stays null; other columns are not
    read; without vectors the result is empty.  Sums and distances are exact however large the
    components are; inertias and distances beyond a long are given as the largest long.
    """
    scratch = Scratch(spark)
    rows = scratch.table(quantised(vectors, dim, scale, id_col, vec_col).select("vec_id", "q", *_hashes()), "vectors")
    centroids = seeds(rows, k, seed)
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, copies bigint"
    if not centroids:
        return spark.createDataFrame([], schema)
    distinct = scratch.table(rows.groupBy("q").agg(F.count("*").alias("copies")), "distinct")
    for _ in range(rounds):
        for at, (n, sums) in _sums(distinct, centroids, dim).items():
            centroids[at] = [v // n for v in sums]
    done = scratch.table(_assigned(distinct, centroids, dim).select("*", *_hashes()), "assigned")
    own = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("copies")).alias("total")).collect()  # a row a cluster
    inertia = {r.cluster: int(r.total) for r in own}
    facts = [(at, min(v, MOST), min(sum(inertia.values()), MOST), hashlib.sha256(",".join(map(str, centroids[at])).encode()).hexdigest()) for at, v in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # by hashes alone where they tell all distinct vectors apart, else by the vectors themselves
    keys = ["h1", "h2"] if done.groupBy("h1", "h2").count().where("count > 1").isEmpty() else ["q"]
    counts = done.select(*keys, F.col("copies").alias("times"))
    total = rows.count()
    out = spread_join(rows.select("vec_id", *keys), done.select(*keys, "cluster", "distance", "copies"), keys, counts, total, "vec_id")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "copies")  # facts: a row a cluster


def sql(table: str = "embeddings", k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same as DuckDB SQL."""
    ctes = [
        f"kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as q from {table} where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim})",
        f"c0 as materialized (select cast(row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as integer) as cluster, q as c from kept order by sha256('{seed}:' || vec_id) limit {k})",
    ]
    for n in range(rounds + 1):
        ctes.append(f"a{n} as materialized (select r, cluster, distance from (select r, cluster, cast(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as distance from kept, c{n}) qualify row_number() over (partition by r order by distance, cluster) = 1)")
        if n < rounds:
            floored = "cast((s - ((s % n) + n) % n) // n as bigint)"
            ctes.append(f"m{n} as (select cluster, list({floored} order by pos) as c from (select cluster, pos, cast(sum(x) as bigint) as s, count(*) as n from (select cluster, unnest(q) as x, generate_subscripts(q, 1) as pos from a{n} join kept using (r)) group by all) group by cluster)")
            ctes.append(f"c{n + 1} as materialized (select cluster, coalesce(m{n}.c, c{n}.c) as c from c{n} left join m{n} using (cluster))")
    return "with " + ",\n".join(ctes) + f"""
select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
  sha256(list_aggregate(list_transform(c, lambda x: cast(x as varchar)), 'string_agg', ',')) as centroid_sha256, count(*) over (partition by q) as copies
from a{rounds} join kept using (r) join c{rounds} using (cluster)"""
