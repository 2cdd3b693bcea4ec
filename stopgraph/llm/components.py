"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, remove


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """``(id, component)`` for every id in ``edges(a, b)``; the component is its smallest id.

    Each round is two joins against per-vertex minima (aggregated map-side), so no task
    gathers a vertex's neighbours and a hub with many links is only a skewed join key,
    which adaptive execution splits.  Rounds go on until no link changes.  Rounds are written to the shared folder.  Null ids
    and self links are ignored; an empty table gives an empty one.
    """
    spark = scratch.spark
    star = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star = scratch.table(star, f"{name}-0")

    def digest(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen, k = digest(star), 0
    while seen[0]:
        # large star: every larger neighbour of u links to the smallest of u and its neighbours
        both = star.union(star.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = star.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours link to the smallest of those
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        small = small.where("u <> v").distinct()
        k += 1
        star = scratch.table(small, f"{name}-{k}")
        now = digest(star)
        remove(spark, scratch.paths.pop(f"{name}-{k - 1}"))
        if now == seen:
            break
        seen = now
    ends = star.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(star.select(F.col("v"), F.col("v")).distinct())
