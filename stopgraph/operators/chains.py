"""Reachability on the event graph by chains: a stop's departures in order, a trip's events in order.

Waiting edges link the departures of a stop, and rides and stays link the events of a trip, so who
reaches one of a chain's events reaches all after it.  What a query has reached is then a place in
each chain, and a step enters whole stretches of chains: the departures from the new place of a
stop's chain to the old one, and of the trips entered there the events up to where they were
entered before.  Each event is entered once a query, and steps follow changes of vehicle and not
hops.  Boarding edges, from an arrival to the first departure at its stop or at one walked to, are
the places where a stop's chain is entered; none is written down.

Chains are written once in buckets of stops and of trips; a step reads the pages of its own ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import bucketed, discard, written
from . import local
from .arrivals import HORIZON, _between, _kept, source_labels


@dataclass
class Chains:
    """Departures by stop, all events by trip, and arrivals by stop where searches go backwards too."""

    departures: DataFrame
    events: DataFrame
    arrivals: DataFrame | None


def event_chains(conn: DataFrame, both_ways: bool = False) -> Chains:
    """The chains of ``conn`` written in buckets."""
    leave = bucketed(conn.select(F.col("from_stop").alias("stop"), "trip", "seq", F.col("dep").alias("t")), "departures", ["stop"], ["t"])
    come = bucketed(conn.select(F.col("to_stop").alias("stop"), "trip", "seq", F.col("arr").alias("t")), "arrivals", ["stop"], ["t"]) if both_ways else None
    return Chains(leave, bucketed(conn.select("trip", "seq", "from_stop", "to_stop", "dep", "arr"), "events", ["trip"], ["seq"]), come)


def _turned(walks: DataFrame) -> DataFrame:
    return walks.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")


def _earlier(old: DataFrame | None, new: DataFrame, keys: list[str], place: str) -> DataFrame:
    """``(keys, place, old, high, better)``: the least place in each chain, the one before, and whether it is new."""
    new = new.select(*keys, place, F.lit(None).cast("int").alias("old"), "high")
    both = new if old is None else old.select(*keys, place, F.col(place).alias("old"), "high").union(new)
    both = both.groupBy(*keys).agg(F.min(place).alias(place), F.min("old").alias("old"), F.min("high").alias("high"))
    return written(both.withColumn("better", F.expr(f"old is null or {place} < old")), "chains")


def reach(chains: Chains, walks: DataFrame, seeds: DataFrame, backwards: bool = False, within: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Places reached in chains: ``(q_id, stop, t, ...)`` and ``(q_id, trip, seq, ...)``, from ``seeds(q_id, stop, t, high)``.

    No event after ``high`` is entered.  ``backwards`` takes minutes and places in trips with
    their signs turned and walks against their direction, so that an arrival's chain are the
    arrivals before it.  With ``within(q_id, trip, last)`` only those trips are entered, and
    left at ``last`` at the latest.
    """
    sign = -1 if backwards else 1
    own = lambda c: (sign * F.col(c)).alias(c)
    entries = (chains.arrivals if backwards else chains.departures).select("stop", "trip", own("seq"), (sign * F.col("t")).alias("at"))
    leave, at = ("from_stop", "dep") if backwards else ("to_stop", "arr")
    exits = chains.events.select("trip", (sign * F.col("seq")).alias("place"), F.col(leave).alias("stop"), (sign * F.col(at)).alias("t"))
    walks = _turned(walks) if backwards else walks
    waits, rides = _earlier(None, seeds, ["q_id", "stop"], "t"), None
    while True:
        front = waits.where("better").select("q_id", "stop", "t", "old", "high")
        near = _between(entries, "stop", front)
        on = front.join(near, "stop").where("at >= t and at <= high and (old is null or at < old)").groupBy("q_id", "trip", "high").agg(F.min("seq").alias("seq"))
        if within is not None:
            on = on.join(within, ["q_id", "trip"]).where("seq <= last").select("q_id", "trip", "high", "seq")
        grown = _earlier(rides, on, ["q_id", "trip"], "seq")
        if rides is not None:
            discard(rides)
        rides = grown
        front = rides.where("better").select("q_id", "trip", "seq", "old", "high")
        if front.isEmpty():
            return waits, rides
        if within is not None:
            front = front.join(within, ["q_id", "trip"])
        off = front.join(_between(exits, "trip", front), "trip").where("place >= seq and (old is null or place < old) and t <= high")
        off = off.where("place <= last") if within is not None else off
        off = off.groupBy("q_id", "stop", "high").agg(F.min("t").alias("t"))
        walked = off.join(walks.hint("merge"), off.stop == walks.u).select("q_id", F.col("v").alias("stop"), "high", (F.col("t") + F.col("w")).alias("t")).where("t <= high")
        grown = _earlier(waits, off.select("q_id", "stop", "high", "t").union(walked), ["q_id", "stop"], "t")
        discard(waits)
        waits = grown


def _by_horizons(od: DataFrame, last: int | None, answer) -> DataFrame:
    """``(q_id, src, dst, t_dep, ea)`` by ``answer(left, span)``, whose ``t`` is right up to ``span`` minutes after the start.

    Queries without an arrival in their horizon go on with a longer one until it is past the
    ``last`` minute; an arrival beyond it is right only then.
    """
    left, done, span = od.select("q_id", "src", "dst", "t_dep"), None, HORIZON
    while True:
        got = written(left.join(answer(left, span).select("q_id", F.col("t").alias("ea")), "q_id", "left"), "answers")
        past = F.lit(True) if last is None else F.coalesce(F.col("t_dep") + span >= last, F.lit(True))
        sure = F.coalesce(F.col("ea") <= F.col("t_dep") + span, F.lit(False)) | past
        done = got.where(sure) if done is None else done.union(got.where(sure))
        left = got.where(~sure).drop("ea")
        if left.isEmpty():
            return done.select("q_id", "src", "dst", "t_dep", F.col("ea").cast("int").alias("ea"))
        span *= 2


def _seeds(asked: DataFrame, walks: DataFrame, high) -> DataFrame:
    return source_labels(asked, walks).join(asked.select("q_id", high.alias("high")), "q_id")


def earliest(conn: DataFrame, walks: DataFrame, od: DataFrame, both_ways: bool = False) -> DataFrame:
    """Earliest arrivals by reachability on the event graph's chains; with ``both_ways`` from both ends.

    From both ends, the events that lead to a target within the horizon are found first, and
    the forward search keeps to them.
    """
    chains, walks = event_chains(conn, both_ways), _kept(walks)
    back_walks = written(_turned(walks), "walks") if both_ways else None

    def answer(left: DataFrame, span: int) -> DataFrame:
        end, within = F.col("t_dep") + span, None
        if both_ways:
            turned = left.select("q_id", F.col("dst").alias("src"), (-end).alias("t_dep"), (-F.col("t_dep")).alias("high"))
            _, led = reach(chains, walks, _seeds(turned, back_walks, F.col("high")), True)
            within = led.select("q_id", "trip", (-F.col("seq")).alias("last"))
        waits, _ = reach(chains, walks, _seeds(left, walks, end), False, within)
        return waits.join(left.select("q_id", F.col("dst").alias("stop")), ["q_id", "stop"])

    return _by_horizons(od, conn.agg(F.max("arr")).first()[0], answer)


def _scan(batches):
    """One scan of each query's connections in order; a walk only follows a strict improvement by a ride."""
    query, goal, label, on, over = None, None, {}, set(), False
    out = lambda q, t: pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([t], pa.int32())], ["q_id", "t"])
    for b in batches:
        for q, dst, _, dep, arr, trip, _, start, stop, to, far in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if q != query:
                if query is not None:
                    yield out(query, label.get(goal))
                query, goal, label, on, over = q, dst, {}, set(), False
            if dep is None:  # where the query can be without a ride
                label[stop] = min(arr, label.get(stop, arr))
                continue
            if over or dep >= label.get(goal, local.NEVER):
                over = True
                continue
            if trip not in on and dep < label.get(start, local.NEVER):
                continue
            on.add(trip)
            if arr < label.get(stop, local.NEVER):
                label[stop] = arr
                for v, w in zip(to or (), far or (), strict=True):
                    label[v] = min(arr + w, label.get(v, local.NEVER))
    if query is not None:
        yield out(query, label.get(goal))


def single_pass(conn: DataFrame, walks: DataFrame, od: DataFrame) -> DataFrame:
    """``local.single_pass`` of written connections that no task can hold; trips are in order of time.

    A scan boards nothing that the exact search does not, so a query's scan is of the events that
    it reaches within its horizon: they are found by chains, put in order of departure and
    streamed, each with the walks from where it ends.
    """
    chains, walks = event_chains(conn), _kept(walks)
    near = walks.groupBy(F.col("u").alias("to_stop")).agg(F.collect_list(F.struct("v", "w")).alias("near"))  # walks of a stop: bounded by the cap
    near = written(near.select("to_stop", F.col("near.v").alias("to"), F.col("near.w").alias("far")), "near")

    def answer(left: DataFrame, span: int) -> DataFrame:
        seeds = written(_seeds(left, walks, F.col("t_dep") + span), "seeds").where("t is not null")
        waits, rides = reach(chains, walks, seeds)
        rides = rides.select("q_id", "trip", F.col("seq").alias("board"), "high")
        rows = rides.join(_between(chains.events, "trip", rides), "trip").where("seq >= board and dep <= high").join(near, "to_stop", "left")
        rows = rows.select("q_id", F.lit(1).alias("kind"), "dep", "arr", "trip", "seq", "from_stop", "to_stop", "to", "far")
        none = lambda c: F.lit(None).cast(dict(rows.dtypes)[c]).alias(c)
        begin = seeds.select("q_id", F.lit(0).alias("kind"), none("dep"), F.col("t").alias("arr"), none("trip"), none("seq"), none("from_stop"), F.col("stop").alias("to_stop"), none("to"), none("far"))
        rows = begin.union(rows).join(left.select("q_id", "dst"), "q_id").select("q_id", "dst", "kind", *rows.columns[2:])
        dealt = rows.repartition(conn.sparkSession.sparkContext.defaultParallelism, "q_id").sortWithinPartitions("q_id", "kind", "dep", "arr", "trip", "seq")
        got = written(dealt.mapInArrow(_scan, "q_id int, t int"), "scans")
        discard(waits, rides)
        return got

    return _by_horizons(od, conn.agg(F.max("dep")).first()[0], answer)


def one_scan(conn: DataFrame, walks: DataFrame, od: DataFrame) -> DataFrame:
    """The one-scan search of written connections: on each task's own tables where they fit, by chains beyond."""
    held = local.hold(conn, walks)
    return single_pass(conn, walks, od) if held is None else local.earliest(conn, walks, od, mode="single_pass", held=held)
