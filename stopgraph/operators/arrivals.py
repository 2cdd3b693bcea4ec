"""Earliest arrivals and latest departures for batches of queries, by rounds of relations.

A round boards every trip that a newly improved label can catch, rides it, and walks once
from every stop reached, improved or not.  That is the exact answer: a walk is never followed
by a walk, and a stop walked into early does not hide the walks from a later ride there.

Connections are needed by stop and by trip in each round.  :func:`network` writes both once,
in buckets, so that rounds shuffle their labels only, however large the timetable is; within
a bucket rows lie in order of stop and departure, or of trip, and a round reads the pages between
the least and the greatest stop, and trip, of its labels.
Timetables that :mod:`.local` can hold are searched there (:func:`answer`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import bucketed, discard, written
from . import local, scans
from .edits import overlay


#: Minutes of the first horizon; a minute that no label has.
HORIZON, NEVER = 64, 1 << 30


@dataclass
class Network:
    """Connections by the stop that they leave, and by trip; ``kept``: in files in order of both."""

    departures: DataFrame
    rides: DataFrame
    kept: bool = False
    spent: list = field(default_factory=list)

    def last(self) -> int | None:
        """The minute of the last departure."""
        return self.departures.agg(F.max("dep")).first()[0]

    def board(self, front: DataFrame, since: int) -> DataFrame:
        """``(q_id, trip, board)``: the first place where each trip is caught from ``front(q_id, stop, t)``."""
        until = "dep >= t and dep <= high" if "high" in front.columns else "dep >= t"
        near = self.departures.where(F.col("dep") >= since)
        if self.kept:
            near = _between(near, "stop", front)
        return front.join(near, "stop").where(until).groupBy("q_id", "trip").agg(F.min("seq").alias("board"))

    def carry(self, on: DataFrame) -> DataFrame:
        """``(q_id, stop, t)`` where the trips boarded get to."""
        rides = _between(self.rides, "trip", on) if self.kept else self.rides
        return on.join(rides, "trip").where("seq >= board").groupBy("q_id", F.col("to_stop").alias("stop")).agg(F.min("arr").alias("t"))

    def ride(self, front: DataFrame, since: int) -> DataFrame:
        """``(q_id, stop, t)`` where trips boarded once from ``front(q_id, stop, t)`` get to."""
        on = self.board(front, since)
        if self.kept:
            on = written(on, "boards")
            self.spent.append(on)
        return self.carry(on)


def _between(rows: DataFrame, key: str, near: DataFrame) -> DataFrame:
    """The ``rows`` from the least to the greatest ``key`` of ``near``: of files in order of it, only those pages are read."""
    low, high = near.agg(F.min(key), F.max(key)).first()
    return rows.where(F.lit(False)) if low is None else rows.where(F.col(key).between(low, high))


@dataclass
class Overlaid:
    """A kept network with edit sets laid over it; the set of a query is the remainder of its number by ``sets``.

    Of a set, trips ``gone(edit_set, trip)`` are not boarded and the connections ``new(edit_set, ...)``
    are; the network is there once, whatever the number of sets.
    """

    base: Network
    gone: DataFrame
    new: DataFrame
    sets: int
    spent: list = field(default_factory=list)

    def last(self) -> int | None:
        both = [x for x in (self.base.last(), self.new.agg(F.max("dep")).first()[0]) if x is not None]
        return max(both) if both else None

    def ride(self, front: DataFrame, since: int) -> DataFrame:
        of_set = F.pmod("q_id", F.lit(self.sets)).cast("int").alias("edit_set")
        on = written(self.base.board(front, since).select("*", of_set), "boards")
        stay = on.join(_between(self.gone, "trip", on), ["edit_set", "trip"], "left_anti").select("q_id", "trip", "board")
        until = "dep >= t and dep <= high" if "high" in front.columns else "dep >= t"
        near = _between(self.new.where(F.col("dep") >= since), "from_stop", front.select(F.col("stop").alias("from_stop")))
        near = near.select("edit_set", F.col("from_stop").alias("stop"), "trip", "seq", "dep")
        come = front.select("*", of_set).join(near, ["edit_set", "stop"]).where(until).groupBy("q_id", "edit_set", "trip").agg(F.min("seq").alias("board"))
        come = written(come, "boards")
        self.spent += [on, come]
        added = come.join(_between(self.new.select("edit_set", "trip", "seq", "to_stop", "arr"), "trip", come), ["edit_set", "trip"])
        added = added.where("seq >= board").select("q_id", F.col("to_stop").alias("stop"), F.col("arr").alias("t"))
        rides = self.base.carry(stay).union(added)
        return rides.groupBy("q_id", "stop").agg(F.min("t").alias("t"))


def _pieces(conn: DataFrame) -> Network:
    return Network(conn.select(F.col("from_stop").alias("stop"), "trip", "seq", "dep"), conn.select("trip", "seq", "to_stop", "arr"))


def network(conn: DataFrame) -> Network:
    """Connections written in buckets of stops and of trips."""
    both = _pieces(conn)
    return Network(bucketed(both.departures, "departures", ["stop"], ["dep"]), bucketed(both.rides, "rides", ["trip"], ["seq"]), True)


def _kept(walks: DataFrame) -> DataFrame:
    """``walks`` as a written table: they are read in each round."""
    return walks if hasattr(walks, "written_to") else written(walks, "walks")


def source_labels(od: DataFrame, walks: DataFrame) -> DataFrame:
    """Minutes at which each query can be at a stop without riding: its source and walks from it."""
    start = od.select("q_id", F.col("src").alias("stop"), F.col("t_dep").alias("t"))
    walked = start.join(walks, start.stop == walks.u).select("q_id", F.col("v").alias("stop"), (F.col("t") + F.col("w")).alias("t"))
    return start.union(walked).groupBy("q_id", "stop").agg(F.min("t").alias("t"))


def _round(front: DataFrame, net, walks: DataFrame, since: int) -> DataFrame:
    """Labels reached by boarding once from ``front(q_id, stop, t)``, and a walk after it."""
    ride = net.ride(front, since)
    # walks are not broadcast: they grow with the stops, and each round would send them again
    walked = ride.join(walks.hint("merge"), ride.stop == walks.u).select("q_id", F.col("v").alias("stop"), (F.col("t") + F.col("w")).alias("t"))
    return ride.union(walked).groupBy("q_id", "stop").agg(F.min("t").alias("t"))


def labels(conn: DataFrame | Network, walks: DataFrame, od: DataFrame, max_boardings: int | None = None, prune: bool = True, bounds=None, span: int | None = None) -> DataFrame:
    """``(q_id, stop, t)``: the earliest minute at each stop that a query reaches.

    ``max_boardings`` bounds the trips boarded.  With ``prune``, labels that are no earlier
    than the query's best arrival are not followed; ``bounds(front)`` adds ``lb`` to
    ``front(q_id, stop, t, dst)``, a lower bound of the time from the stop to the destination
    that sharpens this.  With ``span``, departures later than that many minutes after a query's
    start are not boarded.  Without these, labels of all stops are right (one to all).  Rounds
    go on until no label changes.
    """
    net = _pieces(conn) if isinstance(conn, DataFrame) else conn
    walks = _kept(walks)
    best = written(source_labels(od, walks), "labels")
    front, k = best, 0
    while max_boardings is None or k < max_boardings:
        if prune:
            limits = od.select("q_id", F.col("dst").alias("stop"), (F.col("t_dep") + span).alias("high") if span is not None else F.lit(None).cast("int").alias("high"))
            limits = limits.join(best.withColumnRenamed("t", "goal"), ["q_id", "stop"], "left").select("q_id", F.col("stop").alias("dst"), "goal", "high")
            front = front.join(limits, "q_id")
            if bounds is not None:
                front = bounds(front)
                front = front.where(F.col("goal").isNull() | (F.col("t") + F.coalesce("lb", F.lit(0)) < F.col("goal")))
            else:
                front = front.where("goal is null or t < goal")
            # the last departure that can matter
            high = F.coalesce(F.least(F.col("goal") - 1, "high"), F.lit(NEVER))
            front = front.select("q_id", "stop", "t", high.alias("high"))
        since = front.agg(F.min("t")).first()[0]
        if since is None:
            break
        new = _round(front, net, walks, since)
        # labels so far and new ones in one table, and which of them are other than before
        both = best.select("q_id", "stop", "t", F.col("t").alias("old")).union(new.select("q_id", "stop", "t", F.lit(None).cast("int")))
        both = both.groupBy("q_id", "stop").agg(F.min("t").alias("t"), F.min("old").alias("old"))
        both = written(both.select("q_id", "stop", "t", F.expr("old is null or t < old").alias("better")), "labels")
        k += 1
        discard(best, *getattr(net, "spent", ()))
        getattr(net, "spent", []).clear()
        front, best = both.where("better").select("q_id", "stop", "t"), both.select("q_id", "stop", "t")
        best.written_to = both.written_to
    return best


def at_destination(od: DataFrame, reached: DataFrame) -> DataFrame:
    """``(q_id, src, dst, t_dep, ea)``; a destination not reached has none."""
    return od.join(reached.select("q_id", F.col("stop").alias("dst"), F.col("t").alias("ea")), ["q_id", "dst"], "left").select("q_id", "src", "dst", "t_dep", F.col("ea").cast("int").alias("ea"))


def earliest(conn: DataFrame | Network, walks: DataFrame, od: DataFrame, max_boardings: int | None = None, bounds=None) -> DataFrame:
    """Earliest arrivals of ``od(q_id, src, dst, t_dep)``, exact or within a number of trips.

    Departures up to a horizon are boarded first: as no connection arrives before it departs,
    an arrival within the horizon cannot be bettered beyond it.  Queries without one go on
    with a horizon four times as long, until it is past the last departure.
    """
    net = _pieces(conn) if isinstance(conn, DataFrame) else conn
    walks = _kept(walks)
    last = net.last()
    left, done, span = od, None, HORIZON
    while True:
        reached = labels(net, walks, left, max_boardings, True, bounds, span)
        got = written(at_destination(left, reached), "answers")
        discard(reached)
        past = F.lit(True) if last is None else F.col("t_dep") + span >= last
        sure = F.coalesce(F.col("ea") <= F.col("t_dep") + span, F.lit(False)) | past
        done = got.where(sure) if done is None else done.union(got.where(sure))
        left = got.where(~sure).select("q_id", "src", "dst", "t_dep")
        if left.isEmpty():
            return done
        span *= 4


def ready(conn: DataFrame, walks: DataFrame) -> Broadcast | scans.Slices | Network:
    """What :func:`answer` searches of written connections: tables of each task where they fit, minutes beyond, and a network where trips go back in time."""
    return local.hold(conn, walks) or scans.slices(conn, walks) or network(conn)


def answer(conn: DataFrame, walks: DataFrame, od: DataFrame, max_boardings: int | None = None, held: Broadcast | scans.Slices | Network | None = None) -> DataFrame:
    """:func:`earliest` of written connections, on each task's own tables where they fit, by minutes beyond, and by rounds where boardings are bounded.

    Callers that ask more than once of one timetable give what :func:`ready` gave for it.
    """
    if max_boardings is not None and not isinstance(held, (Broadcast, Network)):
        held = local.hold(conn, walks) or network(conn)
    held = held or ready(conn, walks)
    if isinstance(held, scans.Slices):
        return scans.earliest(held, od)
    if isinstance(held, Network):
        return earliest(held, walks, od, max_boardings)
    return local.earliest(conn, walks, od, max_boardings, held=held)


def reach_all(conn: DataFrame, walks: DataFrame, od: DataFrame) -> DataFrame:
    """``(q_id, stop, t)`` for all stops reached: on each task's own tables where they fit, by minutes beyond."""
    held = ready(conn, walks)
    if isinstance(held, scans.Slices):
        return scans.one_to_all(held, od)
    if not isinstance(held, Network):
        return local.one_to_all(conn, walks, od, held)
    return labels(held, walks, od, prune=False).select("q_id", "stop", F.col("t").cast("int").alias("t"))


def latest(conn: DataFrame, walks: DataFrame, od: DataFrame, switch: bool = False) -> DataFrame:
    """``(q_id, src, dst, deadline, ld)``: the latest departure that still meets the deadline.

    The mirror image of :func:`earliest`: rides are followed back from where they are left,
    walks are taken against their direction.  With ``switch``, as :func:`answer`.
    """
    back = conn.select("trip", (-F.col("seq")).alias("seq"), F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), (-F.col("arr")).alias("dep"), (-F.col("dep")).alias("arr"))
    turned = od.select("q_id", F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("deadline")).alias("t_dep"))
    got = (answer if switch else earliest)(back, walks.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"), turned)
    return od.join(got.select("q_id", (-F.col("ea")).alias("ld")), "q_id").select("q_id", "src", "dst", "deadline", F.col("ld").cast("int").alias("ld"))


def answer_worlds(conn: DataFrame, walks: DataFrame, od: DataFrame, world: str, worlds: int) -> DataFrame:
    """:func:`answer` for queries of several worlds (edit sets, walk caps) at once.

    All three tables have a column ``world`` with numbers from 0 to before ``worlds``; stops
    and trips of each world get numbers of their own, so one search serves all of them.
    """
    own = lambda c: (F.col(c) * worlds + F.col(world)).alias(c)
    c = written(conn.select(own("trip"), "seq", own("from_stop"), own("to_stop"), "dep", "arr"), "worlds")
    w = written(walks.select(own("u"), own("v"), "w"), "walks")
    q = od.select(own("q_id"), own("src"), own("dst"), "t_dep")
    got = answer(c, w, q)
    back = lambda c: F.floor(F.col(c) / worlds).cast("int").alias(c)
    return got.select(F.pmod("q_id", F.lit(worlds)).cast("int").alias(world), back("q_id"), back("src"), back("dst"), "t_dep", "ea")


def answer_edit_sets(conn: DataFrame, walks: DataFrame, od: DataFrame, edits: DataFrame, sets: int, held: Broadcast | scans.Slices | Network | None = None) -> DataFrame:
    """``(edit_set, q_id, src, dst, t_dep, ea)`` of all queries in each of the edit sets from 0 to before ``sets``.

    The timetable is held, or written as a network, once, and each set is laid over it.
    """
    each = conn.sparkSession.range(sets).select(F.col("id").cast("int").alias("edit_set"))
    asked = od.join(F.broadcast(each), F.lit(True))  # a row a set
    held = held or ready(conn, walks)
    gone, new = overlay(conn, edits)
    gone, new = written(gone, "gone"), written(new, "new")
    if isinstance(held, scans.Slices):
        return scans.earliest_overlaid(held, asked, gone, new)
    if not isinstance(held, Network):
        found = local.earliest_overlaid(held, asked, gone, new)
        if found is not None:
            return found
        held = scans.slices(conn, walks) or network(conn)
        if isinstance(held, scans.Slices):
            return scans.earliest_overlaid(held, asked, gone, new)
    own = asked.select((F.col("q_id") * sets + F.col("edit_set")).alias("q_id"), "src", "dst", "t_dep")
    got = earliest(Overlaid(held, gone, new, sets), walks, own)
    number = F.floor(F.col("q_id") / sets).cast("int")
    return got.select(F.pmod("q_id", F.lit(sets)).cast("int").alias("edit_set"), number.alias("q_id"), "src", "dst", "t_dep", "ea")


def on_grid(conn: DataFrame, walks: DataFrame, od: DataFrame, t_lo: int, t_hi: int) -> DataFrame:
    """:func:`answer` on a grid of minutes: queries that start, or end, outside it have no answer."""
    inside = conn.where((F.col("dep") >= t_lo) & (F.col("arr") <= t_hi))
    asked = od.where(F.col("t_dep").between(t_lo, t_hi))
    got = answer(inside, walks, asked).select("q_id", F.when(F.col("ea") <= t_hi, F.col("ea")).alias("ea"))
    return od.join(got, "q_id", "left").select("q_id", "src", "dst", "t_dep", "ea")


def pure_walk(od: DataFrame, walks: DataFrame) -> DataFrame:
    """Arrival without riding: at once where source and destination are one, else by walk."""
    out = od.join(walks, (F.col("src") == F.col("u")) & (F.col("dst") == F.col("v")), "left")
    return out.select("q_id", F.when(F.col("src") == F.col("dst"), F.col("t_dep")).otherwise(F.col("t_dep") + F.col("w")).cast("int").alias("ea"))
