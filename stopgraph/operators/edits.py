"""Edits of a timetable as views: delays, cancellations and added trips folded by trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.minutes import clip_minutes
from ..sources.store import written
from .relational import with_previous

EDIT_SCHEMA = "edit_set int, pos int, edit_type string, trip_id int, delta_min int, template_trip_id int, start_minute int, active boolean"


def draw(*parts: Column | str, seed: int = 0) -> Column:
    """A number from 0 up to 1 drawn by a hash: the same for the same parts everywhere."""
    key = F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def sample_trips(conn: DataFrame, n: int, seed: int) -> DataFrame:
    """About ``n`` trips, each mode with its share, the last ones filled up to exactly ``n``."""
    return _sampled(*_drawn(conn, n, seed), n)


def _drawn(conn: DataFrame, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` trips of each mode by draw, and the modes' numbers of trips."""
    trips = conn.groupBy("trip").agg(F.min("mode").alias("mode"))
    total = trips.agg(F.count("*").alias("total"))
    share = trips.groupBy("mode").agg(F.count("*").alias("in_mode")).join(F.broadcast(total), F.lit(True))
    w = Window.partitionBy("mode").orderBy("draw", "trip")
    return trips.withColumn("draw", draw("trip", seed=seed)).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most), share


def _sampled(drawn: DataFrame, share: DataFrame, n: int) -> DataFrame:
    quota = share.select("mode", F.floor(F.lit(n) * F.col("in_mode") / F.col("total")).alias("quota"))
    drawn = drawn.where(F.col("k") <= n).join(F.broadcast(quota), "mode")
    # within the quotas first, then by draw: at most n rows of each mode are left here
    order = drawn.withColumn("late", F.col("k") > F.col("quota")).orderBy("late", "draw", "trip").limit(n)
    return order.select("trip", "mode", "draw")


def delays(conn: DataFrame, n: int, seed: int) -> DataFrame:
    return _delays(sample_trips(conn, n, seed), seed)


def _delays(trips: DataFrame, seed: int) -> DataFrame:
    return trips.select(F.col("trip").alias("trip_id"), F.lit("DELAY").alias("edit_type"), (1 + F.floor(draw("trip", F.lit("delta"), seed=seed) * 5)).cast("int").alias("delta_min"))


def cancellations(conn: DataFrame, n: int, seed: int) -> DataFrame:
    return _cancellations(sample_trips(conn, n, seed))


def _cancellations(trips: DataFrame) -> DataFrame:
    return trips.select(F.col("trip").alias("trip_id"), F.lit("CANCELLATION").alias("edit_type"))


def additions(conn: DataFrame, n: int, seed: int, t_lo: int = 0, t_hi: int = 780) -> DataFrame:
    """Trips in free windows of a route: between starts, and before and after them in the day.

    A window keeps five minutes from both its ends and is 15 minutes wide at least.  Of each
    route one window is drawn with a probability in proportion to its width, by the smallest
    of the draws' logarithms over the widths, and ``n`` routes are taken by that key.
    """
    return _additions(_windows(conn, seed, t_lo, t_hi), n, seed)


def _windows(conn: DataFrame, seed: int, t_lo: int = 0, t_hi: int = 780) -> DataFrame:
    """The window drawn of each route, with its key."""
    starts = conn.groupBy("route_int", "trip").agg(F.min("dep").alias("start"))
    edges = with_previous(starts, ["route_int"], "start", "trip", ["trip", "start"])
    low, high = F.lit(t_lo + 5), F.lit(t_hi - 5)
    between = edges.where("near is not null").select("route_int", "near.trip", F.lit("after").alias("side"), (F.col("near.start") + 5).alias("lo"), (F.col("start") - 5).alias("hi"))
    before = edges.where("near is null").select("route_int", "trip", F.lit("before").alias("side"), low.alias("lo"), (F.col("start") - 5).alias("hi"))
    last = starts.groupBy("route_int").agg(F.max(F.struct("start", "trip")).alias("last"))
    after = last.select("route_int", "last.trip", F.lit("after").alias("side"), (F.col("last.start") + 5).alias("lo"), high.alias("hi"))
    gaps = between.union(before).union(after).where("hi - lo >= 15")
    key = -F.ln(draw("trip", "side", seed=seed) + F.lit(1e-9)) / (F.col("hi") - F.col("lo"))
    pick = gaps.groupBy("route_int").agg(F.min(F.struct(key.alias("key"), "trip", "side", "lo", "hi")).alias("one"))
    return pick.select("route_int", "one.*")


def _additions(windows: DataFrame, n: int, seed: int) -> DataFrame:
    pick = windows.orderBy("key", "route_int").limit(n)
    start = F.col("lo") + F.floor(draw("trip", F.lit("start"), seed=seed) * (F.col("hi") - F.col("lo") + 1))
    return pick.select(F.col("trip").alias("template_trip_id"), F.lit("ADDITION").alias("edit_type"), start.cast("int").alias("start_minute"))


def build_edit_set(conn: DataFrame, scenario: str, n: int, seed: int, edit_set: int = 0) -> DataFrame:
    """An edit set of ``n`` edits of one kind, in the columns of ``EDIT_SCHEMA``."""
    makers = {"DELAY": delays, "CANCELLATION": cancellations, "ADDITION": additions}
    if scenario not in makers:
        raise ValueError(f"unknown scenario: {scenario}")
    return _as_edits(makers[scenario](conn, n, seed), edit_set)


def build_edit_sets(conn: DataFrame, arms: list[tuple[str, int]], seed: int) -> DataFrame:
    """:func:`build_edit_set` of each of ``arms``, kind and number, numbered from 0: trips are drawn, and windows looked for, once for all."""
    starts = written(conn.groupBy("route_int", "trip").agg(F.min("mode").alias("mode"), F.min("dep").alias("dep")), "starts")
    drawn, share = (written(x, "drawn") for x in _drawn(starts, max(n for _, n in arms), seed))
    windows, out = written(_windows(starts, seed), "windows"), None
    for k, (kind, n) in enumerate(arms):
        made = _additions(windows, n, seed) if kind == "ADDITION" else _delays(_sampled(drawn, share, n), seed) if kind == "DELAY" else _cancellations(_sampled(drawn, share, n))
        one = _as_edits(made, k)
        out = one if out is None else out.unionByName(one)
    return out


def _as_edits(made: DataFrame, edit_set: int) -> DataFrame:
    column = lambda c: F.col(c) if c in made.columns else F.lit(None).cast("int")
    key = F.coalesce(column("trip_id"), column("template_trip_id"))
    return made.select(F.lit(edit_set).alias("edit_set"), key.cast("int").alias("pos"), "edit_type", *[column(c).cast("int").alias(c) for c in ("trip_id", "delta_min", "template_trip_id", "start_minute")], F.lit(True).alias("active"))


def numbered(rows: DataFrame, by: list[str], order: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their place, from one on, among those of equal ``by`` in ``order`` (whole numbers), then ``ties``.

    Ranges of 4096 numbers are numbered apart and shifted by what is before them, so one task
    orders a range only.
    """
    dealt = rows.withColumn("__range", F.floor(F.col(order) / 4096))
    sizes = dealt.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*by, "__range").orderBy(order, *ties)
    place = (F.col("__start") + F.row_number().over(within)).cast("int")
    return dealt.join(sizes, [*by, "__range"]).withColumn(name, place).drop("__range", "__start")


def fold(edits: DataFrame) -> DataFrame:
    """One row a trip of each edit set: whether it is cancelled in the end, and its whole delay.

    Edits follow ``pos``; a restoration undoes the trip's cancellations before it; inactive
    edits count for nothing; edits of one set leave the others alone.
    """
    live = edits.where(F.coalesce("active", F.lit(True)) & F.col("edit_type").isin("DELAY", "CANCELLATION", "RESTORE"))
    last = F.max_by("edit_type", F.when(F.col("edit_type") != "DELAY", F.col("pos")))
    return live.groupBy("edit_set", F.col("trip_id").alias("trip")).agg(F.coalesce(last == "CANCELLATION", F.lit(False)).alias("cancelled"), F.coalesce(F.sum(F.when(F.col("edit_type") == "DELAY", F.col("delta_min"))), F.lit(0)).cast("int").alias("delta"))


def _shift(conn: DataFrame, delta: Column) -> DataFrame:
    return conn.withColumns({"dep": clip_minutes(F.col("dep") + delta).cast("int"), "arr": clip_minutes(F.col("arr") + delta).cast("int")})


def apply_edit_sets(conn: DataFrame, edits: DataFrame, sets: DataFrame | None = None, first_new_trip: int | None = None) -> DataFrame:
    """The edited connections of each edit set, with its number as ``edit_set``.

    Cancelled trips are gone, delayed ones shifted, added ones appended.  ``sets(edit_set)``
    may name sets without any edit.  Unknown trips and templates change nothing.  An added
    trip copies its template as given, starts at ``start_minute``, or ``delta_min`` after the
    template where that is null, and gets a number of its own after all others, in order of
    ``pos``; one that would leave 16 bits is refused whole, and a CANCEL_ADDED edit of its
    number takes it back.  Links between events are views over the result, so they are right
    without any repair.
    """
    sets = edits.select("edit_set").distinct() if sets is None else sets
    live = edits.where(F.coalesce("active", F.lit(True)))
    base = conn.join(F.broadcast(sets), F.lit(True))  # a row a set: scenarios, not trips
    kept = base.join(fold(edits), ["edit_set", "trip"], "left").where(~F.coalesce("cancelled", F.lit(False)))
    kept = _shift(kept, F.coalesce("delta", F.lit(0))).select("edit_set", *conn.columns)
    top = F.lit(first_new_trip - 1) if first_new_trip is not None else F.col("top")
    new = numbered(live.where(F.col("edit_type") == "ADDITION"), ["edit_set"], "pos", "place", ("template_trip_id", "start_minute", "delta_min"))
    if first_new_trip is None:
        new = new.join(F.broadcast(conn.agg(F.max("trip").alias("top"))), F.lit(True))  # one row
    new = new.select("edit_set", (top + F.col("place")).cast("int").alias("new_trip"), F.col("template_trip_id").alias("trip"), "start_minute", "delta_min")
    gone = live.where(F.col("edit_type") == "CANCEL_ADDED").select("edit_set", F.col("trip_id").alias("new_trip"))
    new = new.join(gone, ["edit_set", "new_trip"], "left_anti")
    # a template's own rows only
    begin = conn.join(new.select("trip").distinct(), "trip", "left_semi").groupBy("trip").agg(F.min("dep").alias("begin"), F.max("arr").alias("end"))
    new = new.join(begin, "trip").withColumn("by", F.coalesce(F.col("start_minute") - F.col("begin"), F.col("delta_min")))
    new = new.where("end + by between -32768 and 32767 and begin + by between -32768 and 32767")
    added = conn.join(new.select("edit_set", "trip", "new_trip", "by"), "trip")
    added = added.withColumns({"dep": (F.col("dep") + F.col("by")).cast("int"), "arr": (F.col("arr") + F.col("by")).cast("int"), "trip": F.col("new_trip")})
    return kept.unionByName(added.select("edit_set", *conn.columns))


def named_part(conn: DataFrame, edits: DataFrame) -> tuple[DataFrame, int | None]:
    """The connections of trips that ``edits`` name, written, and the greatest trip of all: what :func:`overlay` and :func:`delta` read."""
    named = edits.select(F.explode(F.array("trip_id", "template_trip_id")).alias("trip")).where("trip is not null").distinct()
    return written(conn.join(named, "trip", "left_semi").select(*conn.columns), "part"), conn.agg(F.max("trip")).first()[0]


def overlay(conn: DataFrame, edits: DataFrame, part: tuple[DataFrame, int | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(edit_set, trip)`` that go and the connections that come: each set as its difference from ``conn``.

    Only rows of trips that an edit names are read, once (``part``, of :func:`named_part`, has them
    already); see :func:`apply_edit_sets` for what edits do.
    """
    part, top = part or named_part(conn, edits)
    gone = fold(edits).where("cancelled or delta <> 0").select("edit_set", "trip")
    edited = apply_edit_sets(part, edits, None, 1 if top is None else top + 1)
    come = edited.join(gone, ["edit_set", "trip"], "left_semi")
    return gone, come if top is None else come.union(edited.where(F.col("trip") > top).select(come.columns))


def apply_edits(conn: DataFrame, edits: DataFrame, first_new_trip: int | None = None) -> DataFrame:
    """The edited connections of all ``edits`` taken as one set; see :func:`apply_edit_sets`."""
    one = edits.withColumn("edit_set", F.lit(0))
    sets = conn.sparkSession.range(1).select(F.lit(0).alias("edit_set"))
    return apply_edit_sets(conn, one, sets, first_new_trip).drop("edit_set")


def apply_edits_to_named(conn: DataFrame, edits: DataFrame) -> DataFrame:
    """:func:`apply_edits`, with only the trips that ``edits`` name taken through them; others pass as they are."""
    top = conn.agg(F.max("trip")).first()[0]
    if top is None:
        return conn
    named = edits.select(F.explode(F.array("trip_id", "template_trip_id")).alias("trip")).where("trip is not null").distinct()
    return conn.join(named, "trip", "left_anti").select(*conn.columns).unionByName(apply_edits(conn.join(named, "trip", "left_semi"), edits, top + 1))


def delta(conn: DataFrame, before: DataFrame | None, after: DataFrame, part: tuple[DataFrame, int | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Connections that go and that come when the edits ``before`` become ``after``.

    Only trips that either names are looked at, so the cost follows the edits.  ``before`` may
    be None: the timetable as it was.  A connection that both leave as it is is in neither.
    ``part``, of :func:`named_part` for both, spares reading ``conn``.
    """
    top = part[1] if part else conn.agg(F.max("trip")).first()[0]
    if top is None:
        return conn, conn
    if part:
        old = part[0] if before is None else apply_edits(part[0], before, top + 1)
        new = apply_edits(part[0], after, top + 1)
        return old.exceptAll(new), new.exceptAll(old)
    logs = [e for e in (before, after) if e is not None]
    named = None
    for e in logs:
        one = e.select(F.explode(F.array("trip_id", "template_trip_id")).alias("trip")).where("trip is not null")
        named = one if named is None else named.union(one)
    part = conn.join(named.distinct(), "trip", "left_semi")
    old = part if before is None else apply_edits(part, before, top + 1)
    new = apply_edits(part, after, top + 1)
    return old.exceptAll(new), new.exceptAll(old)


def apply_phases(conn: DataFrame, edits: DataFrame) -> DataFrame:
    """Delays first, then cancellations, then additions, whatever their order in the set."""
    phase = F.when(F.col("edit_type") == "DELAY", 0).when(F.col("edit_type") == "CANCELLATION", 1).otherwise(2)
    return apply_edits(conn, edits.withColumn("pos", phase.cast("long") * (1 << 40) + F.col("pos")))


def refused(conn: DataFrame, edits: DataFrame, t_lo: int, t_hi: int) -> DataFrame:
    """Edits that a strict application refuses, with why: ``(edit_set, pos, edit_type, trip_id, reason)``."""
    trips = conn.groupBy("trip").agg(F.min("dep").alias("begin"), F.max("arr").alias("end"))
    known = edits.withColumn("trip", F.coalesce("trip_id", "template_trip_id")).where("edit_type <> 'CANCEL_ADDED'").join(trips, "trip", "left")
    by = F.when(F.col("edit_type") == "ADDITION", F.coalesce(F.col("start_minute") - F.col("begin"), F.col("delta_min"))).when(F.col("edit_type") == "DELAY", F.col("delta_min"))
    outside = (F.col("begin") + by < t_lo) | (F.col("end") + by > t_hi)
    reason = F.when(F.col("begin").isNull(), "unknown trip").when(outside, "out of range")
    return known.withColumn("reason", reason).where("reason is not null").select("edit_set", "pos", "edit_type", F.col("trip").alias("trip_id"), "reason")


def apply_strictly(conn: DataFrame, edits: DataFrame, t_lo: int, t_hi: int) -> DataFrame:
    """:func:`apply_edits`, or an error where an edit names no trip or leaves the window."""
    bad = refused(conn, edits, t_lo, t_hi).orderBy("edit_set", "pos").first()
    if bad is not None:
        raise ValueError(f"{bad.edit_type} of trip {bad.trip_id}: {bad.reason}")
    return apply_edits(conn, edits)


def batch_counts(conn: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of each set by kind, trips touched, and edits of trips that do not exist."""
    trips = conn.select(F.col("trip").alias("known")).distinct()
    both = edits.join(trips, F.coalesce("trip_id", "template_trip_id") == F.col("known"), "left")
    kinds = [F.count_if(F.col("edit_type") == k).alias(f"n_{k.lower()}") for k in ("DELAY", "CANCELLATION", "ADDITION", "RESTORE", "CANCEL_ADDED")]
    return both.groupBy("edit_set").agg(F.count("*").alias("n_edits"), *kinds, F.countDistinct("known").alias("n_trips"), F.count_if(F.col("known").isNull()).alias("n_unknown"))


def needs_compaction(conn: DataFrame, edits: DataFrame, share: float = 0.25) -> bool:
    """Whether the edit log touches more than a share of the trips."""
    touched = edits.agg(F.countDistinct("trip_id")).first()[0]
    return touched > share * conn.agg(F.countDistinct("trip")).first()[0]


def compact(conn: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """Write the edited connections as the new base table, in order of departure."""
    apply_edits(conn, edits).repartitionByRange("dep").sortWithinPartitions("dep", "arr").write.parquet(path)
    return conn.sparkSession.read.parquet(path)
