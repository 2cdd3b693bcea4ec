"""Min-plus closures: walks up to a cap, shortest paths from sources, all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import discard, written


#: Edges from which on they are put in order of their start, so a round reads those of its front.
MANY = 1_000_000


def _relax(edges: DataFrame, seeds: DataFrame, cap: int | None, goals: DataFrame | None = None) -> DataFrame:
    """Least ``d`` of (``root``, ``v``) over paths from ``seeds(root, v, d)``; semi-naive rounds.

    With ``goals(root, v)``, a root that has reached all of its goals goes no further.
    """
    edges, ordered = edges.select("u", F.col("v").alias("x"), "w"), None
    if cap is None and edges.count() > MANY:
        edges = ordered = written(edges.repartitionByRange("u").sortWithinPartitions("u"), "edges")
    best = written(seeds.groupBy("root", "v").agg(F.min("d").alias("d")).withColumn("better", F.lit(True)), "best")
    while True:
        front = best.where("better").select("root", "v", "d")
        if goals is not None:
            front = front.join(goals.join(best, ["root", "v"], "left_anti").select("root").distinct(), "root", "left_semi")
        low, high = front.agg(F.min("v"), F.max("v")).first()
        if low is None:
            break
        near = edges if ordered is None else edges.where(F.col("u").between(low, high))
        step = front.join(near.withColumnRenamed("u", "v"), "v").select("root", F.col("x").alias("v"), (F.col("d") + F.col("w")).alias("d"))
        if cap is not None:
            step = step.where(F.col("d") <= cap)
        # distances so far and new ones in one table: those so far are not sent to all tasks each round
        both = best.select("root", "v", "d", F.col("d").alias("old")).union(step.select("root", "v", "d", F.lit(None).cast(dict(best.dtypes)["d"])))
        both = both.groupBy("root", "v").agg(F.min("d").alias("d"), F.min("old").alias("old"))
        both = written(both.select("root", "v", "d", F.expr("old is null or d < old").alias("better")), "best")
        discard(best)
        best = both
    if ordered is not None:
        discard(ordered)
    out = best.select("root", "v", "d")
    out.written_to = best.written_to
    return out


def walk_closure(walks: DataFrame, cap: int = 15, least: int = 1) -> DataFrame:
    """All walks of at most ``cap`` minutes over chains of ``walks(u, v, w)``; u <> v.

    Legs are whole minutes, of ``least`` at least, so a chain has at most ``cap / least`` of
    them.  Up to four the closure is a plan of that many joins and nothing runs before it is
    asked for; longer ones run in rounds.
    """
    legs = walks.where((F.col("w") > 0) & (F.col("w") <= cap) & (F.col("u") != F.col("v"))).groupBy("u", "v").agg(F.min("w").cast("int").alias("w"))
    hops, out = cap // least, legs
    if hops > 4:
        closed = _relax(legs, legs.select(F.col("u").alias("root"), "v", F.col("w").alias("d")), cap)
        return closed.where("root <> v").select(F.col("root").alias("u"), "v", F.col("d").alias("w"))
    for _ in range(hops - 1):
        further = out.select("u", F.col("v").alias("m"), F.col("w").alias("w1")).join(legs.where(F.col("w") >= least).select(F.col("u").alias("m"), "v", F.col("w").alias("w2")), "m").select("u", "v", (F.col("w1") + F.col("w2")).alias("w"))
        out = out.union(further.where((F.col("w") <= cap) & (F.col("u") != F.col("v")))).groupBy("u", "v").agg(F.min("w").alias("w"))
    return out


def closures_by_cap(walks: DataFrame, caps: DataFrame, most: int, least: int = 1) -> DataFrame:
    """``(cap, u, v, w)`` for each of ``caps(cap)`` up to ``most``: one closure, cut at each cap."""
    closed = walk_closure(walks, most, least)
    return closed.join(F.broadcast(caps.where(F.col("cap") <= most)), F.col("w") <= F.col("cap")).select("cap", "u", "v", "w")  # a row a cap


def shortest_paths(edges: DataFrame, sources: DataFrame, cap: int | None = None) -> DataFrame:
    """``(root, v, d)`` from each of ``sources(root)`` over ``edges(u, v, w)``, itself at 0."""
    return _relax(edges, sources.select("root", F.col("root").alias("v"), F.lit(0).alias("d")), cap)


def reached(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs(root, v)`` with a path over ``edges(u, v, w)``; a root's search ends with the last of its pairs."""
    goals = written(pairs.select("root", "v").distinct(), "goals")
    seen = _relax(edges, goals.select("root", F.col("root").alias("v"), F.lit(0).alias("d")), None, goals)
    return goals.join(seen.select("root", "v"), ["root", "v"], "left_semi")
