"""Joins, windows and aggregations over connections: the pieces of event graphs and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.minutes import overtaking_class

#: Minutes of a slot: a stop's events are dealt by stop and slot, so a busy stop is many tasks' work.
SLOT = 15


def _slot(minute: str):
    return F.floor(F.col(minute) / SLOT).cast("int").alias("slot")


def _beyond(rows: DataFrame, value: str, forward: bool) -> DataFrame:
    """``(stop, slot, beyond)``: the first value of the slots after each one, or the last of those before.

    One row for each slot of a stop is left when slots are put in order.
    """
    best = (F.min if forward else F.max)(value).alias("own")
    frame = Window.partitionBy("stop").orderBy("slot")
    frame = frame.rowsBetween(1, Window.unboundedFollowing) if forward else frame.rowsBetween(Window.unboundedPreceding, -1)
    carried = (F.first if forward else F.last)("own", ignorenulls=True).over(frame)
    return rows.groupBy("stop", "slot").agg(best).select("stop", "slot", carried.alias("beyond"))


def collapse_same_stop(stop_times: DataFrame) -> DataFrame:
    """Merge consecutive rows of a trip at one stop: first arrival, last departure."""
    order = Window.partitionBy("trip").orderBy("stop_sequence")
    new = (F.lag("stop").over(order).isNull() | (F.lag("stop").over(order) != F.col("stop"))).cast("int")
    runs = stop_times.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("trip", "run").agg(F.min("stop_sequence").alias("stop_sequence"), F.first("stop").alias("stop"), F.min("arrival_time").alias("arrival_time"), F.max("departure_time").alias("departure_time"), *[F.min_by(c, "stop_sequence").alias(c) for c in ("route_int", "mode") if c in stop_times.columns]).drop("run")


def service_date(stop_times: DataFrame) -> DataFrame:
    """The commonest date of the departures; the earliest of equally common ones."""
    days = stop_times.where("departure_time is not null").groupBy(F.to_date("departure_time").alias("service_date")).count()
    return days.orderBy(F.desc("count"), "service_date").limit(1).select("service_date")


def dense_trips(conn: DataFrame) -> DataFrame:
    """Trips numbered from 0 in order of their ids.

    Numbers need one order over all trips; ranges of ids are numbered apart and shifted by
    the counts of the ranges before, so no task sorts all trips.
    """
    trips = conn.select("trip").distinct().withColumn("range", F.floor(F.col("trip") / 4096))
    sizes = trips.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 4096 ids
    sizes = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("range").orderBy("trip")
    return trips.join(sizes, "range").select("trip", (F.col("start") + F.row_number().over(within) - 1).cast("int").alias("trip_no"))


def next_in_trip(conn: DataFrame) -> DataFrame:
    """Each connection with the next one of its trip: ``nseq, nfrom, nto, ndep, narr``."""
    w = Window.partitionBy("trip").orderBy("seq")
    return conn.select("*", *[F.lead(a).over(w).alias(b) for a, b in (("seq", "nseq"), ("from_stop", "nfrom"), ("to_stop", "nto"), ("dep", "ndep"), ("arr", "narr"))]).where("nseq is not null")


def stay_edges(conn: DataFrame) -> DataFrame:
    return next_in_trip(conn).select("trip", "seq", "nseq", (F.col("ndep") - F.col("arr")).alias("w"))


def gap_stay_edges(conn: DataFrame) -> DataFrame:
    """Stays across missing rows: the next connection leaves from another stop."""
    return next_in_trip(conn).where("to_stop <> nfrom").select("trip", "seq", F.col("to_stop").alias("u"), F.col("nfrom").alias("v"), (F.col("ndep") - F.col("arr")).alias("w"))


def continue_edges(conn: DataFrame) -> DataFrame:
    return next_in_trip(conn).where("narr >= arr").select("trip", "seq", "nseq", (F.col("narr") - F.col("arr")).alias("w"))


def wait_edges(conn: DataFrame) -> DataFrame:
    """From each departure to the next one at its stop."""
    at = conn.select("trip", "seq", "dep", F.col("from_stop").alias("stop"), _slot("dep"), F.struct("dep", "trip", "seq").alias("event"))
    w = Window.partitionBy("stop", "slot").orderBy("event")
    out = at.withColumn("next", F.lead("event").over(w)).join(_beyond(at, "event", True), ["stop", "slot"])
    out = out.withColumn("next", F.coalesce("next", "beyond")).where("next is not null")
    return out.select("trip", "seq", F.col("next.trip").alias("ntrip"), F.col("next.seq").alias("nseq"), (F.col("next.dep") - F.col("dep")).alias("w"))


def minute_wait_edges(stops: DataFrame, t_lo: int, t_hi: int) -> DataFrame:
    """Waiting a minute at each of ``stops(stop)``, in both planes of the grid: ``(plane, stop, t, t2)``."""
    planes = F.explode(F.array(F.lit(0), F.lit(1))).alias("plane")
    at = stops.select("stop", planes).select("plane", "stop", F.explode(F.sequence(F.lit(t_lo), F.lit(t_hi - 1))).alias("t"))
    return at.withColumn("t2", F.col("t") + 1)


def stop_event_index(conn: DataFrame) -> DataFrame:
    """Departures of each stop, numbered in order."""
    at = conn.select(F.col("from_stop").alias("stop"), _slot("dep"), "trip", "seq", "dep")
    sizes = at.groupBy("stop", "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("stop").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("stop", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    w = Window.partitionBy("stop", "slot").orderBy("dep", "trip", "seq")
    pos = (F.col("start") + F.row_number().over(w) - 1).cast("int").alias("pos")
    return at.join(sizes, ["stop", "slot"]).select("stop", pos, "trip", "seq", "dep")


def trip_event_index(conn: DataFrame) -> DataFrame:
    """Events of each trip in order: departure (0) and arrival (1) of each connection."""
    both = conn.select("trip", "seq", F.lit(0).alias("kind"), F.col("dep").alias("t")).union(conn.select("trip", "seq", F.lit(1), "arr"))
    w = Window.partitionBy("trip").orderBy("seq", "kind")
    return both.select("trip", "seq", "kind", "t", (F.row_number().over(w) - 1).alias("pos"))


def with_previous(rows: DataFrame, by: list[str], order: str, tie: str, value: list[str]) -> DataFrame:
    """``rows`` with ``near``: the columns ``value`` of the row before, of equal ``by``, in order of minute and ``tie``.

    Rows without a minute come last; the first row has null.  A group is dealt by slots of
    minutes (of 4096 ties where there is no minute), and one row a slot carries the last of
    the slots before, so a group of many rows is many tasks' work.
    """
    slot = F.when(F.col(order).isNotNull(), F.floor(F.col(order) / SLOT)).otherwise(F.lit(1 << 40) + F.floor(F.col(tie) / 4096))
    dealt = rows.withColumns({"__slot": slot, "__own": F.struct(*value)})
    place = F.struct(F.col(order).isNull(), F.col(order), F.col(tie))
    ends = dealt.groupBy(*by, "__slot").agg(F.max_by("__own", place).alias("__last"))
    ends = ends.withColumn("__beyond", F.lag("__last").over(Window.partitionBy(*by).orderBy("__slot")))
    w = Window.partitionBy(*by, "__slot").orderBy(F.asc_nulls_last(order), tie)
    here = dealt.withColumn("__near", F.lag("__own").over(w)).alias("a")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "__slot")]
    return here.join(ends.alias("b"), same).select(*[F.col(f"a.{c}") for c in rows.columns], F.coalesce("__near", "__beyond").alias("near"))


def departed_before(rows: DataFrame) -> DataFrame:
    """``rows(stop, dep, trip, seq, ...)`` with ``near``: the minute of the departure before at the stop, in order of minute, trip and place."""
    at = rows.withColumn("slot", _slot("dep"))
    w = Window.partitionBy("stop", "slot").orderBy("dep", "trip", "seq")
    here = at.withColumn("near", F.lag("dep").over(w)).join(_beyond(at.select("stop", "slot", "dep"), "dep", False), ["stop", "slot"])
    return here.withColumn("near", F.coalesce("near", "beyond")).drop("beyond", "slot")


def stop_route_position(stop_times: DataFrame) -> DataFrame:
    """First position of each stop on each route."""
    return stop_times.groupBy("stop", F.col("route_int")).agg(F.min("seq").alias("pos"))


def route_trips(stop_times: DataFrame) -> DataFrame:
    """Starts of each route's trips: their number, the first and the last, and all in order."""
    starts = stop_times.groupBy("route_int", "trip").agg(F.min("dep").alias("start"))
    ordered = F.concat_ws(",", F.sort_array(F.collect_list("start"))).alias("starts")
    return starts.groupBy("route_int").agg(F.count("*").cast("int").alias("n_trips"), F.min("start").alias("first"), F.max("start").alias("last"), ordered)


def route_tables(conn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes as ``(route_int, pos, stop)`` and ``(route_int, trip, pos, arr, dep)``, from connections.

    Derived from trip and place in the trip, so edited connections give edited routes.  The
    first stop of a trip has no arrival and the last one no departure.
    """
    leave = conn.select("route_int", "trip", F.col("seq").alias("pos"), F.col("from_stop").alias("stop"), F.lit(None).cast("int").alias("arr"), "dep")
    come = conn.select("route_int", "trip", (F.col("seq") + 1).alias("pos"), F.col("to_stop").alias("stop"), "arr", F.lit(None).cast("int").alias("dep"))
    times = leave.union(come).groupBy("route_int", "trip", "pos", "stop").agg(F.max("arr").alias("arr"), F.max("dep").alias("dep"))
    return times.select("route_int", "pos", "stop").distinct(), times.select("route_int", "trip", "pos", "stop", "arr", "dep")


def fifo_adjacent(stop_times: DataFrame) -> DataFrame:
    """Arrival inversions of a route's trips next to each other by first departure, with their kind."""
    first = stop_times.groupBy("trip").agg(F.min_by("dep", F.when(F.col("dep").isNotNull(), F.col("seq"))).alias("start"))
    times = stop_times.join(first, "trip").select("route_int", "seq", "trip", "arr", "dep", "start")
    rows = with_previous(times, ["route_int", "seq"], "start", "trip", ["trip", "arr", "dep"]).where("near.arr > arr")
    kind = overtaking_class(F.col("near.dep"), F.col("dep"), F.col("near.arr"), F.col("arr"))
    return rows.select("route_int", "seq", F.col("near.trip").alias("earlier"), "trip", kind.alias("kind"))


def fifo_pairs(stop_times: DataFrame) -> DataFrame:
    """Inversions at a later position of trips next to each other at an earlier one, counted by kind."""
    here = stop_times.where("dep is not null").select("route_int", "trip", F.col("seq").alias("x"), F.col("dep").alias("dep_x"))
    later = stop_times.where("arr is not null").select("trip", F.col("seq").alias("y"), F.col("arr").alias("arr_y"))
    both = here.join(later, "trip").where("x < y")
    pairs = with_previous(both, ["route_int", "x", "y"], "dep_x", "trip", ["dep_x", "arr_y"]).where("near.arr_y > arr_y")
    gap = F.col("dep_x") - F.col("near.dep_x")
    kind = F.when(gap > 720, "wraparound").when(gap > 0, "overtaking").otherwise("data_error")
    return pairs.groupBy("route_int", kind.alias("kind")).agg(F.count("*").alias("n_inversions"))


def fifo_decision(violations: DataFrame) -> DataFrame:
    """Counts by kind, and whether to go on."""
    counts = violations.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("nat", "wraparound", "overtaking", "data_error")])
    return counts.withColumn("decision", F.when((F.col("n_overtaking") > 0) | (F.col("n_data_error") > 0), "block_reopen_stage_2").when((F.col("n_nat") > 0) | (F.col("n_wraparound") > 0), "proceed_with_note").otherwise("proceed"))


def busiest_stops(conn: DataFrame, n: int) -> DataFrame:
    return conn.groupBy(F.col("from_stop").alias("stop")).agg(F.count("*").alias("departures")).orderBy(F.desc("departures"), "stop").limit(n)


def board_asof(events: DataFrame, conn: DataFrame, tag: list[str]) -> DataFrame:
    """For each of ``events(tag..., stop, t)`` the first departure at its stop from then on.

    Events and departures of a slot of a stop are put in one order and the next departure is
    looked up by a window; where the slot has none, the first one of the slots after it is
    taken.  So a stop with many of both costs a sort of each slot, not their product.
    """
    dep = conn.select(*[F.lit(None).cast(dict(events.dtypes)[c]).alias(c) for c in tag], F.col("from_stop").alias("stop"), F.col("dep").alias("t"), F.lit(1).alias("kind"), F.struct("dep", "trip", "seq").alias("next"))
    ask = events.select(*tag, "stop", "t", F.lit(0).alias("kind"), F.lit(None).cast(dict(dep.dtypes)["next"]).alias("next"))
    both = ask.union(dep).withColumn("slot", _slot("t"))
    # equal departures in order of trip, the first one nearest to the events before them
    w = Window.partitionBy("stop", "slot").orderBy("t", "kind", "next").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("found", F.first("next", ignorenulls=True).over(w)).where("kind = 0")
    found = found.join(_beyond(both, "next", True), ["stop", "slot"]).withColumn("found", F.coalesce("found", "beyond"))
    return found.where("found is not null").select(*tag, "stop", "t", F.col("found.dep").alias("bdep"), F.col("found.trip").alias("btrip"), F.col("found.seq").alias("bseq"))


def arrival_events(conn: DataFrame) -> DataFrame:
    return conn.select("trip", "seq", F.col("to_stop").alias("stop"), F.col("arr").alias("t"))


def walked_events(conn: DataFrame, walks: DataFrame) -> DataFrame:
    """Arrivals carried over each walk: the stop and minute where it ends."""
    at = arrival_events(conn)
    return at.join(walks, at.stop == walks.u).select("trip", "seq", F.col("v").alias("stop"), (F.col("t") + F.col("w")).alias("t"))


def board_in_asof(events: DataFrame, conn: DataFrame) -> DataFrame:
    """For each departure the latest arrival at its stop up to then."""
    arr = conn.select(F.lit(None).cast("int").alias("trip"), F.lit(None).cast("int").alias("seq"), F.col("to_stop").alias("stop"), F.col("arr").alias("t"), F.lit(0).alias("kind"), F.struct("arr", "trip", "seq").alias("last"))
    ask = events.select("trip", "seq", F.col("from_stop").alias("stop"), F.col("dep").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(dict(arr.dtypes)["last"]).alias("last"))
    both = ask.union(arr).withColumn("slot", _slot("t"))
    w = Window.partitionBy("stop", "slot").orderBy("t", "kind", "last").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("found", F.last("last", ignorenulls=True).over(w)).where("kind = 1")
    found = found.join(_beyond(both, "last", False), ["stop", "slot"]).withColumn("found", F.coalesce("found", "beyond"))
    return found.where("found is not null").select("trip", "seq", "stop", "t", F.col("found.arr").alias("barr"))


def source_attachment(od: DataFrame, conn: DataFrame, walks: DataFrame) -> DataFrame:
    """Departures that a query can start with: all at its source, the first at each walked stop."""
    own = od.join(conn, od.src == conn.from_stop).where("dep >= t_dep").select("q_id", "trip", "seq", "dep")
    walked = od.join(walks, od.src == walks.u).select("q_id", F.col("v").alias("stop"), (F.col("t_dep") + F.col("w")).alias("t"))
    first = board_asof(walked, conn, ["q_id"]).select("q_id", F.col("btrip").alias("trip"), F.col("bseq").alias("seq"), F.col("bdep").alias("dep"))
    return own.union(first).distinct()


def first_departures(od: DataFrame, conn: DataFrame, walks: DataFrame) -> DataFrame:
    """The first departure at each query's source and at each walked stop; those after them are reached by waiting."""
    here = od.select("q_id", F.col("src").alias("stop"), F.col("t_dep").alias("t"))
    walked = od.join(walks, od.src == walks.u).select("q_id", F.col("v").alias("stop"), (F.col("t_dep") + F.col("w")).alias("t"))
    first = board_asof(here.union(walked), conn, ["q_id"])
    return first.select("q_id", F.col("btrip").alias("trip"), F.col("bseq").alias("seq"), F.col("bdep").alias("dep")).distinct()


def target_attachment(od: DataFrame, conn: DataFrame, walks: DataFrame) -> DataFrame:
    """Arrivals that end a query, with the walk left to its destination."""
    own = od.join(conn, od.dst == conn.to_stop).select("q_id", "trip", "seq", "arr", F.lit(0).alias("tail"))
    near = od.join(walks, od.dst == walks.v).select("q_id", "u", "w").join(conn, F.col("u") == F.col("to_stop")).select("q_id", "trip", "seq", "arr", F.col("w").alias("tail"))
    return own.union(near).groupBy("q_id", "trip", "seq", "arr").agg(F.min("tail").alias("tail"))


def grid_walk_edges(conn: DataFrame, walks: DataFrame, t_hi: int) -> DataFrame:
    """Walks from each distinct arrival that end within the window."""
    at = conn.select(F.col("to_stop").alias("stop"), F.col("arr").alias("t")).distinct()
    return at.join(walks, at.stop == walks.u).select("u", "t", "v", (F.col("t") + F.col("w")).alias("t2")).where(F.col("t2") <= t_hi)


def grid_ride_edges(conn: DataFrame) -> DataFrame:
    """Rides from both planes to the ridden-in plane."""
    planes = F.explode(F.array(F.lit(0), F.lit(1))).alias("plane")
    return conn.select("from_stop", "dep", planes, "to_stop", "arr").distinct()


def grid_exit_edges(conn: DataFrame) -> DataFrame:
    """From the arrival node of each connection to the ridden-in plane of its stop and minute."""
    return conn.select("trip", "seq", F.col("to_stop").alias("stop"), F.col("arr").alias("t"), F.lit(0).alias("w"))


def label_intersection(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Least sum of two labels at a common hub: ``forward(a, hub, d)``, ``backward(b, hub, d)``."""
    return forward.withColumnRenamed("d", "d1").join(backward.withColumnRenamed("d", "d2"), "hub").groupBy("a", "b").agg(F.min(F.col("d1") + F.col("d2")).alias("d"))
