"""Arrivals on timetables of any size by scans of minutes: tasks read connections in order of departure.

Connections lie in the shared folder in a part for each minute of departure (:func:`slices`), with
stops as dense numbers.  A task takes some queries and goes through the minutes once for all of
them: it boards what their labels catch, rides it, and walks once from every stop that a ride
reaches earlier than rides before.  As no connection arrives before it departs, a minute is
settled when it has been gone through, and a query ends when its destination is reached.  A task
holds a minute's rows, two numbers a stop and a bit a trip for each of its queries, of whom it
takes as many at a time as ``HELD`` bytes allow.

Edit sets are laid over the minutes: trips of a set that go are masked and the connections that
come, in parts of ``BLOCK`` minutes, are added.  Timetables in which a trip goes back in time are
not scanned (:func:`slices` gives None).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import shared_dir

#: Stops, and walks, that a task knows at most; bytes of labels that it holds at a time; minutes of a part of new connections.
STOPS, HELD, BLOCK = 8_000_000, 96 << 20, 32
NEVER = np.int32(1 << 30)
_COLUMNS = ["trip", "seq", "start", "end", "dep", "arr"]


@dataclass
class Slices:
    """A timetable by minutes; ``shared`` has stops and walks, ``trips`` the least and the greatest number."""

    folder: str
    minutes: list[int]
    trips: tuple[int, int]
    shared: Broadcast
    kept: bool = True


def _numbers(rows: DataFrame, shared: Broadcast, tag: str) -> DataFrame:
    """``(tag, trip, seq, start, end, dep, arr)`` with numbers of stops."""

    def run(batches):
        stops = shared.value[0]
        for b in batches:
            c = {k: b.column(k) for k in b.schema.names}
            start, end = (np.searchsorted(stops, c[k].to_numpy()).astype(np.int32) for k in ("from_stop", "to_stop"))
            yield pa.RecordBatch.from_arrays([c[tag], c["trip"], c["seq"], pa.array(start), pa.array(end), c["dep"], c["arr"]], [tag, *_COLUMNS])

    ints = [F.col(c).cast("int").alias(c) for c in (tag, "trip", "seq", "from_stop", "to_stop", "dep", "arr")]
    return rows.select(*ints).mapInArrow(run, ", ".join(f"{c} int" for c in (tag, *_COLUMNS)))


def slices(conn: DataFrame, walks: DataFrame) -> Slices | None:
    """``conn`` by minutes of departure in the shared folder; None where a scan would not be right or stops are too many."""
    spark = conn.sparkSession
    ends = conn.select(F.col("from_stop").cast("int").alias("stop")).union(conn.select("to_stop")).union(walks.select("u")).union(walks.select("v")).where("stop is not null").distinct()
    w = walks.select(*[F.col(x).cast("int").alias(x) for x in ("u", "v", "w")]).limit(STOPS + 1).toArrow()
    stops = np.sort(ends.limit(STOPS + 1).toArrow().column(0).to_numpy())
    if len(stops) > STOPS or w.num_rows > STOPS:
        return None
    u, v, m = (w.column(k).to_numpy() for k in "uvw")
    if len(m) and m.min() < 0:
        return None
    by = np.argsort(u, kind="stable")
    at = np.searchsorted(np.searchsorted(stops, u)[by], np.arange(len(stops) + 1))
    shared = spark.sparkContext.broadcast((stops, at, np.searchsorted(stops, v).astype(np.int32)[by], m[by]))
    # a trip's departures must not go back, else those of a minute are not all there is to it
    order = Window.partitionBy("trip").orderBy("seq")
    back = F.expr("arr < dep or coalesce(dep < before, false)").cast("int").alias("back")
    rows = conn.withColumn("before", F.lag("dep").over(order)).select("trip", "seq", "from_stop", "to_stop", "dep", "arr", back)
    folder = f"{shared_dir(spark)}/minutes-{uuid.uuid4().hex}"
    dealt = _numbers(rows, shared, "back").repartition("dep").sortWithinPartitions("dep", "trip", "seq")
    dealt.write.partitionBy("dep").parquet(folder)
    kept = spark.read.schema("back int, trip int, dep int").parquet(folder)
    found = kept.groupBy("dep").agg(F.max("back").alias("back"), F.min("trip").alias("low"), F.max("trip").alias("high")).collect()  # a row a minute
    if any(r.back for r in found):
        return None
    trips = (min(r.low for r in found), max(r.high for r in found)) if found else (0, 0)
    return Slices(folder, sorted(r.dep for r in found), trips, shared)


class _Bits:
    """A set of trips between two numbers."""

    def __init__(self, low: int, high: int):
        self.low, self.bits = low, np.zeros((high - low) // 8 + 1, np.uint8)

    def has(self, trip: np.ndarray) -> np.ndarray:
        at = trip.astype(np.int64) - self.low
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def add(self, trip: np.ndarray) -> None:
        at = trip.astype(np.int64) - self.low
        np.bitwise_or.at(self.bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


class _Parts:
    """Rows of the parts of a folder, as arrays."""

    def __init__(self, folder: str):
        self.store, self.folder = pyarrow.fs.FileSystem.from_uri(folder)

    def read(self, part: str, columns: list[str]) -> list[np.ndarray]:
        found = self.store.get_file_info(pyarrow.fs.FileSelector(f"{self.folder}/{part}", allow_not_found=True))
        tables = [pyarrow.parquet.read_table(self.store.open_input_file(f.path), columns=columns, use_threads=False) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet")]
        return [np.concatenate([t.column(c).to_numpy() for t in tables]) if tables else np.zeros(0, np.int32) for c in columns]


class _Query:
    """Labels of a query: the least minutes at stops, those of them by riding, and trips that it is on."""

    def __init__(self, key: tuple, src: int, dst: int | None, minute: int, walks: tuple, trips: tuple[int, int]):
        self.key, self.dst, self.minute, self.walks = key, dst, minute, walks
        self.label, self.rode, self.on = np.full(len(walks[0]) - 1, NEVER), np.full(len(walks[0]) - 1, NEVER), _Bits(*trips)
        self.label[src] = minute
        self._walk(np.array([src]), np.array([minute], np.int32))

    def _walk(self, stop: np.ndarray, t: np.ndarray) -> None:
        at, to, w = self.walks
        n = at[stop + 1] - at[stop]
        rows = np.repeat(at[stop] - np.cumsum(n) + n, n) + np.arange(n.sum())
        np.minimum.at(self.label, to[rows], np.repeat(t, n) + w[rows])

    def settle(self, now: int, trip: np.ndarray, start: np.ndarray, end: np.ndarray, arr: np.ndarray, first: np.ndarray | None) -> None:
        """Go through the connections of a minute, in order of trip and place; ``first``: where each one's trip begins, if some have several."""
        on = self.on.has(trip)
        while True:
            can = on | (self.label[start] <= now)
            if first is not None:
                can = np.maximum.accumulate(np.where(can, np.arange(len(can)), -1)) >= first
            ride = np.flatnonzero(can)
            stop, t = end[ride], arr[ride]
            better = t < self.rode[stop]
            stop, t = stop[better], t[better]
            if len(stop):
                np.minimum.at(self.rode, stop, t)
                np.minimum.at(self.label, stop, t)
                self._walk(stop, t)
            if not len(stop) or t.min() > now:  # else there may be more to board in this minute
                break
        self.on.add(trip[ride])


def _searched(asked: list[tuple], minutes: Slices, span: tuple[int, int], gone: str | None, come: tuple[str, frozenset] | None):
    """Queries when they are done; ``asked`` of ``(key, edit set, src, dst, minute)`` with numbers of stops."""
    _, *walks = minutes.shared.value
    base, added, active = _Parts(minutes.folder), _Parts(come[0]) if come else None, {}
    away = {}
    for s in {a[1] for a in asked} if gone else ():
        (trips,) = _Parts(gone).read(f"edit_set={s}", ["trip"])
        away[s] = _Bits(*span)
        away[s].add(trips[(trips >= span[0]) & (trips <= span[1])])
    waiting = sorted(asked, key=lambda a: -a[4])
    block, new = None, {}
    for now in sorted({*minutes.minutes, *(come[1] if come else ())}):
        while waiting and waiting[-1][4] <= now:
            key, s, src, dst, minute = waiting.pop()
            active.setdefault(s, []).append(_Query(key, src, dst, minute, walks, span))
        for s, queries in active.items():
            yield from (q for q in queries if q.dst is not None and q.label[q.dst] <= now)
            active[s] = [q for q in queries if q.dst is None or q.label[q.dst] > now]
        active = {s: queries for s, queries in active.items() if queries}
        if not active:
            if not waiting:
                return
            continue
        rows = base.read(f"dep={now}", ["trip", "start", "end", "arr"])
        if come and now // BLOCK != block:
            block, new = now // BLOCK, {}
        for s, queries in active.items():
            own = rows
            if gone and len(rows[0]):
                stay = ~away[s].has(rows[0])
                own = [x[stay] for x in rows]
            if come:
                if s not in new:
                    new[s] = added.read(f"edit_set={s}/block={block}", ["dep", "trip", "start", "end", "arr"])
                here = slice(*np.searchsorted(new[s][0], [now, now + 1]))
                own = [np.concatenate([x, y[here]]) for x, y in zip(own, new[s][1:], strict=True)]
            if not len(own[0]):
                continue
            fresh, first = np.append(True, own[0][1:] != own[0][:-1]), None
            if not fresh.all():
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
            for q in queries:
                q.settle(now, *own, first)
    yield from (q for queries in active.values() for q in queries)
    for key, _, src, dst, minute in waiting:
        yield _Query(key, src, dst, minute, walks, span)


def _dealt(asked: DataFrame, minutes: Slices, span: tuple[int, int], gone: str | None, come: tuple[str, frozenset] | None, give, schema: str) -> DataFrame:
    """``asked(edit_set, q_id, src, dst, t_dep)`` dealt over the tasks; ``give`` makes a batch of a query's row and labels, None where its source is no stop."""

    def run(batches):
        stops = minutes.shared.value[0]
        place = lambda s: int(k) if s is not None and (k := np.searchsorted(stops, s)) < len(stops) and stops[k] == s else None
        most = max(1, HELD // (8 * len(stops) + (span[1] - span[0]) // 8 + 1))
        todo = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s, _, src, dst, minute = row
                a, z = place(src), None if dst is None else place(dst)
                if a is None or minute is None or (dst is not None and z is None):
                    yield give(row, None, None, stops)
                else:
                    todo.append((row, s, a, z, minute))
        todo.sort(key=lambda x: (x[1], x[4]))
        for k in range(0, len(todo), most):
            for q in _searched(todo[k : k + most], minutes, span, gone, come):
                yield give(q.key, q.label, q.dst, stops)

    spark = asked.sparkSession
    return asked.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, schema)


def _arrival(row: tuple, label: np.ndarray | None, dst: int | None, stops: np.ndarray) -> pa.RecordBatch:
    s, q, src, to, minute = row
    if label is None:
        ea = minute if src == to and src is not None else None
    else:
        ea = int(label[dst]) if label[dst] < NEVER else None
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (s, q, src, to, minute, ea)], ["edit_set", "q_id", "src", "dst", "t_dep", "ea"])


def _all(row: tuple, label: np.ndarray | None, dst: int | None, stops: np.ndarray) -> pa.RecordBatch:
    _, q, src, _, minute = row
    if label is None:
        stop, t = (np.array([x], np.int32) for x in (src, minute)) if src is not None and minute is not None else (np.zeros(0, np.int32),) * 2
    else:
        got = np.flatnonzero(label < NEVER)
        stop, t = stops[got].astype(np.int32), label[got]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(t), q, np.int32)), pa.array(stop), pa.array(t)], ["q_id", "stop", "t"])


def _asked(od: DataFrame, edit_set, dst) -> DataFrame:
    columns = [edit_set.cast("int").alias("edit_set"), *[F.col(c).cast("int").alias(c) for c in ("q_id", "src")], dst.cast("int").alias("dst"), F.col("t_dep").cast("int").alias("t_dep")]
    return od.select(*columns)


def earliest(minutes: Slices, od: DataFrame) -> DataFrame:
    """``(q_id, src, dst, t_dep, ea)`` as :func:`.arrivals.earliest`."""
    asked = _asked(od.where("dst is not null"), F.lit(0), F.col("dst"))
    got = _dealt(asked, minutes, minutes.trips, None, None, _arrival, "edit_set int, q_id int, src int, dst int, t_dep int, ea int")
    none = od.where("dst is null").select(*[F.col(c).cast("int").alias(c) for c in ("q_id", "src", "dst", "t_dep")], F.lit(None).cast("int").alias("ea"))
    return got.drop("edit_set").union(none)


def one_to_all(minutes: Slices, od: DataFrame) -> DataFrame:
    """``(q_id, stop, t)``: the earliest minute at each stop that a query reaches, whatever the number of trips."""
    return _dealt(_asked(od, F.lit(0), F.lit(None)), minutes, minutes.trips, None, None, _all, "q_id int, stop int, t int")


def earliest_overlaid(minutes: Slices, od: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """``(edit_set, q_id, src, dst, t_dep, ea)`` for ``od(edit_set, ...)`` as :func:`.local.earliest_overlaid`, of sets of any size."""
    spark, folder = od.sparkSession, f"{shared_dir(od.sparkSession)}/sets-{uuid.uuid4().hex}"
    gone.select("edit_set", "trip").repartition("edit_set").write.partitionBy("edit_set").parquet(f"{folder}/gone")
    rows = _numbers(new, minutes.shared, "edit_set").withColumn("block", F.floor(F.col("dep") / BLOCK).cast("int"))
    rows.repartition("edit_set", "block").sortWithinPartitions("edit_set", "block", "dep", "trip", "seq").write.partitionBy("edit_set", "block").parquet(f"{folder}/come")
    kept = spark.read.schema("trip int, dep int, edit_set int, block int").parquet(f"{folder}/come")
    found = kept.groupBy("dep").agg(F.min("trip").alias("low"), F.max("trip").alias("high")).collect()  # a row a minute
    span = (min([minutes.trips[0], *(r.low for r in found)]), max([minutes.trips[1], *(r.high for r in found)]))
    asked = _asked(od, F.col("edit_set"), F.col("dst"))
    return _dealt(asked, minutes, span, f"{folder}/gone", (f"{folder}/come", frozenset(r.dep for r in found)), _arrival, "edit_set int, q_id int, src int, dst int, t_dep int, ea int")
