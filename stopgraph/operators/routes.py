"""Arrivals by scans of routes: of each route only the earliest trip that can be caught is ridden.

Trips with the same stops make a pattern.  In order of their start they are cut into chains
wherever a trip overtakes the one before it (and after ``CHAIN`` trips), so within a chain an
earlier trip is earlier at every stop.  A chain is a row a position with its trips' minutes as
arrays: the trip caught is the number of departures before the label, and one trip answers
for the whole chain.  A label meets one row a chain and position, not one a trip, and the rows
lie in buckets of stops and of chains, so rounds shuffle labels only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import bucketed, discard, written
from . import arrivals as A

#: Trips of a chain at most, so an array of minutes stays small.
CHAIN = 512


def chains(conn: DataFrame) -> DataFrame:
    """``conn`` with ``pos``, its place in the trip, its ``chain`` and its trip's ``rank`` in it.

    The chain's number is a hash of its pattern and its first trip.
    """
    order = Window.partitionBy("trip").orderBy("seq")
    rows = conn.select("trip", "seq", "from_stop", "to_stop", "dep", "arr", (F.row_number().over(order) - 1).cast("int").alias("pos"))
    # a row a trip: its stops, and its minutes, a few hundred at most
    trips = rows.groupBy("trip").agg(F.sort_array(F.collect_list(F.struct("pos", "from_stop", "to_stop", "dep", "arr"))).alias("way"))
    stops = F.transform("way", lambda x: F.struct(x.from_stop.alias("from_stop"), x.to_stop.alias("to_stop")))
    minutes = F.flatten(F.transform("way", lambda x: F.array(x.dep, x.arr)))
    trips = trips.select("trip", F.sha2(F.to_json(stops), 256).alias("pattern"), minutes.alias("minutes"), F.get("way", F.lit(0)).dep.alias("start"))
    by_start = Window.partitionBy("pattern").orderBy("start", "trip")
    overtakes = F.exists(F.zip_with("minutes", "before", lambda a, b: a < b), lambda x: x)
    trips = trips.withColumn("before", F.lag("minutes").over(by_start))
    trips = trips.select("trip", "pattern", "start", F.coalesce(overtakes, F.lit(False)).cast("int").alias("cut"))
    trips = trips.withColumn("run", F.sum("cut").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("pattern", "run").orderBy("start", "trip")
    trips = trips.withColumn("place", F.row_number().over(in_run) - 1).withColumn("part", F.floor(F.col("place") / CHAIN))
    first = F.min("trip").over(Window.partitionBy("pattern", "run", "part"))
    # told apart by a trip of its own, so two chains never share a number
    trips = trips.select("trip", first.cast("long").alias("chain"), (F.col("place") % CHAIN).cast("int").alias("rank"))
    return rows.join(trips, "trip")


@dataclass
class Routes:
    """Chains by the stop that they leave, ``(stop, chain, pos, deps)``, and by chain, ``(chain, pos, to_stop, arrs)``."""

    leaving: DataFrame
    coming: DataFrame

    def last(self) -> int | None:
        return self.leaving.agg(F.max(F.array_max("deps"))).first()[0]

    def ride(self, front: DataFrame, since: int) -> DataFrame:
        """Where the earliest trip of each chain, boarded once from ``front(q_id, stop, t)``, gets to.

        Of boardings further along a chain only those of an earlier trip than all before count,
        and each rides up to the next one that does.
        """
        at = front.join(self.leaving, "stop").withColumn("rank", F.size(F.filter("deps", lambda d: d < F.col("t"))))
        until = F.get("deps", F.col("rank")) <= F.col("high") if "high" in front.columns else F.lit(True)
        at = at.where((F.col("rank") < F.size("deps")) & until).select("q_id", "chain", "pos", "rank")
        along = Window.partitionBy("q_id", "chain").orderBy("pos")
        best = F.min("rank").over(along.rowsBetween(Window.unboundedPreceding, -1))
        on = at.withColumn("best", best).where("best is null or rank < best").withColumn("until", F.lead("pos").over(along)).drop("best")
        ride = on.withColumnRenamed("pos", "board").join(self.coming, "chain").where("pos >= board and (until is null or pos < until)")
        return ride.groupBy("q_id", F.col("to_stop").alias("stop")).agg(F.min(F.get("arrs", F.col("rank"))).alias("t"))


def routes(conn: DataFrame) -> Routes:
    """The chains of ``conn``, written in buckets of stops and of chains."""
    rows = written(chains(conn), "chains")
    by_rank = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("rank", c))), lambda x: x[c])  # noqa: E731  CHAIN at most
    leaving = rows.groupBy("chain", "pos", F.col("from_stop").alias("stop")).agg(by_rank("dep").alias("deps"))
    coming = rows.groupBy("chain", "pos", "to_stop").agg(by_rank("arr").alias("arrs"))
    return Routes(bucketed(leaving, "leaving", ["stop"], []), bucketed(coming, "coming", ["chain"], ["pos"]))


def journeys(net: Routes, walks: DataFrame, od: DataFrame, max_trips: int | None = None) -> DataFrame:
    """``(q_id, trips, ea)``: arrivals that no journey of as few trips betters, all of one search.

    A round adds one trip to every label, so a label that improves in round ``k`` is the
    earliest at its stop with ``k`` trips, and one that does not is dominated.  Labels no
    earlier than a query's best arrival so far are not followed: with more trips they could
    only do worse.
    """
    best = written(A.source_labels(od, walks), "labels")
    goal = lambda rows, k: rows.join(od.select("q_id", F.col("dst").alias("stop")), ["q_id", "stop"], "left_semi").select("q_id", F.lit(k).alias("trips"), F.col("t").alias("ea"))
    found = [written(goal(best, 0), "journeys")]
    front, k, used = best, 0, []
    while max_trips is None or k < max_trips:
        so_far = found[0]
        for more in found[1:]:
            so_far = so_far.union(more)
        limit = so_far.groupBy("q_id").agg(F.min("ea").alias("goal"))
        front = front.join(limit, "q_id", "left").where("goal is null or t < goal").select("q_id", "stop", "t", (F.coalesce("goal", F.lit(A.NEVER)) - 1).alias("high"))
        since = front.agg(F.min("t")).first()[0]
        if since is None:
            break
        k += 1
        new = A._round(front, net, walks, since).join(best.withColumnRenamed("t", "old"), ["q_id", "stop"], "left")
        front = written(new.where("old is null or t < old").select("q_id", "stop", "t"), "front")
        found.append(written(goal(front, k), "journeys"))
        discard(*used)
        if front.isEmpty():
            discard(front)
            break
        used = [best, front]
        best = written(best.union(front).groupBy("q_id", "stop").agg(F.min("t").alias("t")), "labels")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def within(found: DataFrame, od: DataFrame, bounds: DataFrame) -> DataFrame:
    """:func:`journeys` read for each bound of ``bounds(max_trips)``, null for none: ``(max_trips, q_id, src, dst, t_dep, ea)``."""
    asked = od.join(F.broadcast(bounds), F.lit(True))  # a row a bound
    both = asked.join(found.select(F.col("q_id"), "trips", F.col("ea").alias("at")), "q_id", "left").where("max_trips is null or trips is null or trips <= max_trips")
    got = both.groupBy("max_trips", "q_id").agg(F.min("at").cast("int").alias("ea")).withColumnRenamed("max_trips", "bound")
    return asked.join(got.withColumnRenamed("q_id", "q"), F.col("max_trips").eqNullSafe(F.col("bound")) & (F.col("q_id") == F.col("q")), "left").select("max_trips", "q_id", "src", "dst", "t_dep", "ea")
