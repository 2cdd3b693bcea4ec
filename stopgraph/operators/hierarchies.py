"""Contraction hierarchies of stop graphs, by rounds of relations.

A round contracts, all at once, stops of few edge pairs none of which are neighbours: of two
neighbours the cheaper one goes first, of equally cheap ones that of the smaller hash.  A pair
of edges through a contracted stop becomes a shortcut unless a path of one or two edges among
the stops that stay is as short; a longer witness is not looked for, which costs shortcuts and
never a distance.  Rounds end when every stop left has more pairs of edges than are worth it;
those stops are the core and share the top level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import discard, written
from .closure import shortest_paths

#: Pairs of edges through a stop that is contracted at most; edges out of a stop that a witness
#: of two edges may pass at most.
PAIRS, FAN = 64, 32


def _candidates(left: DataFrame, pairs: int) -> DataFrame:
    """``(stop, key)`` of stops with at most so many pairs of edges through them; keys order them."""
    ends = left.select(F.col("u").alias("stop"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(left.select("v", F.lit(0), F.lit(1)))
    cost = ends.groupBy("stop").agg((F.sum("o") * F.sum("i")).alias("cost"))
    return cost.where(F.col("cost") <= pairs).select("stop", F.struct("cost", F.xxhash64("stop").alias("h"), "stop").alias("key"))


def _independent(left: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(stop)``: candidates that come before all their neighbours that are candidates too."""
    beside = left.select(F.col("u").alias("stop"), F.col("v").alias("other")).union(left.select("v", "u"))
    least = beside.join(candidates.select(F.col("stop").alias("other"), F.col("key").alias("theirs")), "other").groupBy("stop").agg(F.min("theirs").alias("theirs"))
    return candidates.join(least, "stop", "left").where("theirs is null or key < theirs").select("stop")


def _needed(via: DataFrame, rest: DataFrame) -> DataFrame:
    """Shortcuts ``via(u, v, w)`` that no path of one or two edges of ``rest`` makes needless."""
    direct = rest.select("u", "v", F.col("w").alias("known"))
    left = via.join(direct, ["u", "v"], "left").where("known is null or w < known").select("u", "v", "w")
    narrow = rest.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") <= FAN).select("u")
    near = rest.join(narrow, "u", "left_semi")
    first = near.select("u", F.col("v").alias("y"), F.col("w").alias("w1"))
    second = near.select(F.col("u").alias("y"), "v", F.col("w").alias("w2"))
    seen = left.join(first, "u").where("w1 < w").join(second, ["y", "v"]).where("w1 + w2 <= w").select("u", "v").distinct()
    return left.join(seen, ["u", "v"], "left_anti")


def contract(graph: DataFrame, pairs: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """``(stop, level)`` and ``(u, v, w)`` of a stop graph and its shortcuts, for graphs of any size.

    Levels are rounds; stops of the core have the highest.  Loops are left out, and of edges
    between the same two stops the shortest counts.
    """
    least = lambda e: e.groupBy("u", "v").agg(F.min("w").cast("int").alias("w"))
    left = written(least(graph.where("u <> v").select("u", "v", "w")), "left")
    stops = written(graph.select(F.col("u").alias("stop")).union(graph.select("v")).distinct(), "stops")
    levels, edges, k = None, None, 0
    while True:
        chosen = written(_independent(left, _candidates(left, pairs)), "chosen")
        if chosen.isEmpty():
            discard(chosen)
            break
        out = left.join(chosen.withColumnRenamed("stop", "u"), "u", "left_semi").select("u", "v", "w")
        into = left.join(chosen.withColumnRenamed("stop", "v"), "v", "left_semi").select("u", "v", "w")
        gone = written(out.union(into), "upward")
        rest = left.join(chosen.withColumnRenamed("stop", "u"), "u", "left_anti").join(chosen.withColumnRenamed("stop", "v"), "v", "left_anti").select("u", "v", "w")
        via = into.select("u", F.col("v").alias("m"), F.col("w").alias("w1")).join(out.select(F.col("u").alias("m"), "v", F.col("w").alias("w2")), "m").where("u <> v")
        via = written(least(via.select("u", "v", (F.col("w1") + F.col("w2")).alias("w"))), "via")
        now = written(least(rest.union(_needed(via, rest))), "left")
        discard(left, via)
        left = now
        own = chosen.withColumn("level", F.lit(k))
        levels, edges, k = own if levels is None else levels.union(own), gone if edges is None else edges.union(gone), k + 1
    if levels is None:
        return stops.withColumn("level", F.lit(0)), left
    core = stops.join(levels, "stop", "left_anti").withColumn("level", F.lit(k))
    return levels.union(core), edges.union(left)


def upward(levels: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges to higher stops and within the core, and those from higher stops turned round."""
    both = edges.join(levels.select(F.col("stop").alias("u"), F.col("level").alias("lu")), "u").join(levels.select(F.col("stop").alias("v"), F.col("level").alias("lv")), "v")
    return both.where("lu <= lv").select("u", "v", "w"), both.where("lu > lv").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")


def distances(levels: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(q_id, src, dst, d)`` for ``pairs(q_id, src, dst)``: upward from both ends, least sum where they meet.

    The core is crossed from the source's side only.
    """
    up, down = (written(e, "upward") for e in upward(levels, edges))
    ahead = shortest_paths(up, pairs.select(F.col("src").alias("root")).distinct()).select(F.col("root").alias("src"), F.col("v").alias("hub"), F.col("d").alias("d1"))
    back = shortest_paths(down, pairs.select(F.col("dst").alias("root")).distinct()).select(F.col("root").alias("dst"), F.col("v").alias("hub"), F.col("d").alias("d2"))
    met = pairs.join(ahead, "src").join(back, ["dst", "hub"]).groupBy("q_id").agg(F.min(F.col("d1") + F.col("d2")).cast("int").alias("d"))
    return pairs.join(met, "q_id", "left").select("q_id", "src", "dst", "d")
