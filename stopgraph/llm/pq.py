"""Embedding near-duplicates over inverted lists with product-quantised residuals.

Unit vectors lie in the list of their nearest coarse centroid and are coded by the nearest
codeword of each residual subspace.  A neighbour that is nearer to another centroid lies
beyond the bisecting plane of the two centroids, so a vector probes every list whose plane is
within the radius: no link is lost, whatever the vectors' spread.  Lists near each other form
a cell, and a vector is copied to a cell once, however many of its lists it probes.  A pair is
looked at from one side only, the one of the smaller cell or id, and counts for both ends.
There the distance from a vector to each coded one is a sum of looked-up products: one table
for the lists and one for each subspace hold the query's products with centroids and
codewords.  The code's own error, which is stored, bounds how far that sum can be off, so the
codes lose no neighbour; what is left is ranked by exact cosine in doubles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import block_join
from .common import Scratch, binary, small, vectors
from .components import connected_components

#: Vectors of a length that its codebooks are fitted to, about, rounds of fitting, and rows of a block.
SAMPLE, ROUNDS, BLOCK = 8192, 8, 4096
SUBSPACES, CODES = 8, 64
#: Vectors of a coarse list, about, and the number of lists at least and at most.
OF_LIST, LISTS = 100, (8, 4096)
#: Vectors of a cell of lists, about.
OF_CELL = 4096
SLACK = 1e-9
#: Numbers in the samples, and lengths, whose indexes are made at once.
NUMBERS, LENGTHS = 1 << 24, 500


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced rows; fewer rows give fewer."""
    x = np.unique(x, axis=0)
    centre = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = ((centre**2).sum(1)[None] - 2 * x @ centre.T).argmin(1)
        count = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        used = count > 0
        centre[used] = total[used] / count[used][:, None]
    return centre


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, with neither overflow nor underflow of the norm."""
    scaled = x / np.abs(x).max(1)[:, None]
    return scaled / np.sqrt((scaled**2).sum(1))[:, None]


@dataclass
class Index:
    """Lists, cells and codebooks of the vectors of one length."""

    coarse: np.ndarray
    gaps: np.ndarray
    cell_of: np.ndarray
    cuts: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fitted(cls, sample: np.ndarray, total: int, cells: int) -> Index:
        """The index for ``total`` vectors from a sample of them; its cells are numbered from ``cells``."""
        unit, dim = _unit(sample), sample.shape[1]
        coarse = _kmeans(unit, int(np.clip(total / OF_LIST, *LISTS)))
        residual = unit - coarse[_squared(unit, coarse).argmin(1)]
        cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        books = [_kmeans(residual[:, a:z], CODES) for a, z in zip(cuts, cuts[1:], strict=False)]
        # lists near each other form a cell
        middle = _kmeans(coarse, -(-total // OF_CELL))
        return cls(coarse, np.sqrt(_squared(coarse, coarse)), (cells + _squared(coarse, middle).argmin(1)).astype(np.int32), cuts, books)

    def coded(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, the code's error, and the squared length of the decoded vector."""
        own = _squared(u, self.coarse).argmin(1)
        known, codes = self.coarse[own], np.zeros((len(u), SUBSPACES), np.uint8)
        rest = u - known
        for k, book in enumerate(self.books):
            part = slice(self.cuts[k], self.cuts[k + 1])
            codes[:, k] = _squared(rest[:, part], book).argmin(1)
            known[:, part] += book[codes[:, k]]
        return own, codes, np.sqrt(((u - known) ** 2).sum(1)), (known**2).sum(1)

    def probed(self, u: np.ndarray, own: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """``(row, cell)``: the cells, from the own one on, with a list that may hold a neighbour."""
        d = _squared(u, self.coarse)
        # distance to the plane between the own list's centroid and each other one
        plane = (d - d[np.arange(len(d)), own][:, None]) / np.maximum(2 * self.gaps[own], 1e-12)
        row, other = np.nonzero((plane <= radius + SLACK) & (self.cell_of[None] >= self.cell_of[own][:, None]))
        row, cell = np.unique(np.stack([row, self.cell_of[other]]), axis=1)
        return row, cell

    def candidates(self, q: np.ndarray, lists: np.ndarray, codes: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, coded vector) whose looked-up distance, less what is the same for all queries, is within the bound.

        The tables hold a row a list or codeword and a column a query, so a vector's sum adds whole rows of them.
        """
        used, place = np.unique(lists, return_inverse=True)
        found = []
        for a in range(0, len(q), 256):
            part = q[a : a + 256]
            total = (-2 * self.coarse[used] @ part.T).astype(np.float32)[place]
            for k, book in enumerate(self.books):
                total += (-2 * book @ part[:, self.cuts[k] : self.cuts[k + 1]].T).astype(np.float32)[codes[:, k]]
            j, i = np.nonzero(total <= bound[:, None])
            found.append((a + i, j))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _local_links(q: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each node reaches by the links (q, d)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[q], label[d])
        new = label.copy()
        np.minimum.at(new, q, low)
        np.minimum.at(new, d, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(spark: SparkSession, rows: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Vectors of one length link where their cosine is at least ``cosine``.  ``n_links``
    counts the other rows linked directly; equal vectors are one class whose members are
    counted, never paired.  ``component_id`` is the smallest id reachable by links.

    Null vectors, empty or zero ones, and vectors with null or non-finite components link
    with nothing and stand alone; so do rows of null id, whose component is null; vectors
    of different lengths never link; rows that repeat an id each count as a row; other
    columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(spark)
    v = F.col(vec_col).cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.col(id_col).isNotNull()
    sound &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, v).alias("v"))
    classes = given.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = scratch.table(classes.withColumn("dim", F.size("v")), "classes")
    sizes = scratch.table(classes.groupBy("dim").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    counts, labels = None, None
    for k, some in enumerate(_lengths(sizes)):
        found = scratch.table(_linked(scratch, classes, some, cosine, f"index-{k}"), f"linked-{k}")
        counts = found if counts is None else counts.union(found)
    if counts is not None:
        per = counts.groupBy("id").agg(F.sum("n").alias("n"))
        links = counts.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
        labels = connected_components(links, scratch, "vectors")
        by_class = classes.join(per, "id", "left").join(labels, "id", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
        out = given.join(by_class, "v", "left")
    else:
        out = given.select("vec_id", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("component"))
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


LINKED = "id long, n long, low long"


def _lengths(sizes: DataFrame):
    """Lengths with their numbers of vectors, in parts whose samples the driver can hold; all in one part as a rule."""
    part, held = {}, 0
    for r in sizes.orderBy("dim").toLocalIterator():
        numbers = min(r.n, SAMPLE) * r.dim
        if part and (held + numbers > NUMBERS or len(part) == LENGTHS):
            yield part
            part, held = {}, 0
        part[r.dim] = r.n
        held += numbers
    if part:
        yield part


def _by_length(lists: pa.Array):
    """``(rows, vectors)`` for each length among a batch's lists."""
    off = np.asarray(lists.offsets)
    values, size = np.asarray(lists.values), np.diff(off)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, values[off[rows][:, None] + np.arange(dim)]


def _linked(scratch: Scratch, classes: DataFrame, sizes: dict[int, int], cosine: float, name: str) -> DataFrame:
    """``(id, n, low)``: links of vectors of the given lengths, counted block by block, and a forest of them.

    ``n`` is the number of rows linked in one block, ``low`` the smallest id that the
    block's links reach from ``id``; each pair is found in one block and counts for both ends.
    """
    radius = float(np.sqrt(max(2 - 2 * cosine, 0))) + SLACK
    share = F.create_map(*[F.lit(x) for dim, n in sizes.items() for x in (dim, min(SAMPLE / n, 1.0))])
    of = classes.where(F.col("dim").isin(list(sizes)))
    # a hash draws the sample, so nothing is sorted for it
    drawn = of.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share[F.col("dim")] * (1 << 30)).select("dim", "id", "v").toArrow()
    of_dim, ids = drawn.column("dim").to_numpy(), drawn.column("id").to_numpy()
    by_dim, cells = {}, 0
    for dim, n in sizes.items():
        rows = np.flatnonzero(of_dim == dim)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        picked = drawn.column("v").take(pa.array(rows)).combine_chunks()
        by_dim[dim] = Index.fitted(np.asarray(picked.flatten()).reshape(-1, dim), n, cells)
        cells = int(by_dim[dim].cell_of.max()) + 1

    def code(batches):
        for b in batches:
            for rows, x in _by_length(b.column(1)):
                index, u = by_dim[x.shape[1]], _unit(x)
                own, codes, off, size = index.coded(u)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index.cell_of[own]), pa.array(np.full(len(u), x.shape[1], np.int32)), pa.array(own.astype(np.int32)), b.column(0).take(take), binary(u), binary(codes), pa.array(off), pa.array(size), b.column(2).take(take)],
                    ["cell", "dim", "list", "id", "u", "codes", "off", "size", "copies"],
                )

    kind = "cell int, dim int, list int, id long, u binary, codes binary, off double, size double, copies long"
    index = scratch.table(of.select("id", "v", "copies").mapInArrow(code, kind), name)

    def probe(batches):
        for b in small(batches):
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                row, cell = by_dim[int(dim)].probed(vectors(part.column(4), int(dim)), part.column(2).to_numpy(), radius)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(part.column(k).take(take) for k in range(1, 9))], b.schema.names)

    def compare(data: pa.Table, queries: pa.Table):
        dim = data.column("dim")[0].as_py()
        held = by_dim[dim]
        ids, qid = data.column("id").to_numpy(), queries.column("id").to_numpy()
        u, q = vectors(data.column("u"), dim), vectors(queries.column("u"), dim)
        home = held.cell_of[queries.column("list").to_numpy()] == data.column("cell")[0].as_py()
        # above the rounding of single-precision sums
        bound = ((radius + data.column("off").to_numpy() + 1e-4) ** 2 + 2e-5 - data.column("size").to_numpy() - 1).astype(np.float32)
        i, j = held.candidates(q, data.column("list").to_numpy(), vectors(data.column("codes"), SUBSPACES, np.uint8), bound)
        # pairs of the query's own cell come in both orders, others in one
        once = (ids[j] != qid[i]) & (~home[i] | (qid[i] < ids[j]))
        i, j = i[once], j[once]
        keep = np.concatenate([(q[i[a : a + 65536]] * u[j[a : a + 65536]]).sum(1) >= cosine for a in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        n = np.bincount(i, weights=data.column("copies").to_numpy()[j], minlength=len(qid)).astype(np.int64)
        back = np.bincount(j, weights=queries.column("copies").to_numpy()[i], minlength=len(ids)).astype(np.int64)
        # nodes: each distinct id of the two blocks, in order of id
        nodes = np.unique(np.concatenate([ids, qid]))
        label = nodes[_local_links(np.searchsorted(nodes, qid[i]), np.searchsorted(nodes, ids[j]), len(nodes))]
        out_id = np.concatenate([qid[np.unique(i)], ids[np.unique(j)]])
        out_n = np.concatenate([n[np.unique(i)], back[np.unique(j)]])
        return pa.RecordBatch.from_arrays([pa.array(out_id), pa.array(out_n), pa.array(label[np.searchsorted(nodes, out_id)])], ["id", "n", "low"])

    return block_join(index, index.mapInArrow(probe, kind), compare, LINKED, BLOCK)
