"""Arrivals on tables held by each task: many queries against one timetable of a bounded size.

A timetable of up to ``MOST`` connections and as many walks (a large city's day has some two
million) is sent to the executors once, as arrays in order of departure, and queries are dealt
over the tasks.  :func:`hold` is the switch: larger timetables it refuses, and they go the way of
:mod:`.arrivals`, where nothing is broadcast.  What it gives serves any number of searches and
can be destroyed after the last of them has run.

``multi_pass`` is exact: rounds of boarding, riding and walking over arrays, until nothing
changes or as many trips are boarded as allowed.  Only departures up to a horizon are looked
at; an arrival within the horizon cannot be bettered by a later departure, and the horizon
doubles until there is one.  ``single_pass`` is one scan in order of departure that walks from
strictly improved stops only; it can miss walks that a ride reaches later than an early walk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Connections, and walks, that are held by a task at most: about 100 MB.
MOST = 4_000_000
#: Minutes of the first horizon.
HORIZON = 64
NEVER = np.int32(1 << 30)


@dataclass
class Tables:
    """Arrays of a timetable; stops and trips are numbered from 0, connections in order of departure."""

    stops: np.ndarray
    start: np.ndarray
    end: np.ndarray
    trip: np.ndarray
    seq: np.ndarray
    dep: np.ndarray
    arr: np.ndarray
    trips: np.ndarray
    walk_at: np.ndarray
    walk_to: np.ndarray
    walk_w: np.ndarray
    in_order: bool


def fits(conn: DataFrame, walks: DataFrame) -> bool:
    """Whether a timetable is small enough to be held by each task."""
    return conn.count() <= MOST and walks.count() <= MOST


def tables(conn: DataFrame, walks: DataFrame) -> Tables:
    """The arrays of a timetable that :func:`fits`."""
    c = conn.select(*[F.col(x).cast("int").alias(x) for x in ("from_stop", "to_stop", "trip", "seq", "dep", "arr")]).toArrow()
    w = walks.select(*[F.col(x).cast("int").alias(x) for x in ("u", "v", "w")]).toArrow()
    c = {k: c.column(k).to_numpy() for k in c.column_names}
    u, v, m = (w.column(k).to_numpy() for k in "uvw")
    stops = np.unique(np.concatenate([c["from_stop"], c["to_stop"], u, v]))
    by = np.argsort(u, kind="stable")
    at = np.searchsorted(np.searchsorted(stops, u)[by], np.arange(len(stops) + 1))
    return _arranged(c, stops, at, np.searchsorted(stops, v).astype(np.int32)[by], m[by])


def _arranged(c: dict[str, np.ndarray], stops: np.ndarray, walk_at: np.ndarray, walk_to: np.ndarray, walk_w: np.ndarray) -> Tables:
    order = np.lexsort((c["seq"], c["trip"], c["arr"], c["dep"]))
    c = {k: x[order] for k, x in c.items()}
    start, end = (np.searchsorted(stops, c[k]).astype(np.int32) for k in ("from_stop", "to_stop"))
    trips, trip = np.unique(c["trip"], return_inverse=True)
    along = np.lexsort((c["seq"], trip))
    same = trip[along][1:] == trip[along][:-1]
    in_order = bool((c["arr"] >= c["dep"]).all() and (c["dep"][along][1:] >= c["dep"][along][:-1])[same].all())
    return Tables(stops, start, end, trip.astype(np.int32), c["seq"], c["dep"], c["arr"], trips, walk_at, walk_to, walk_w, in_order)


def overlaid(t: Tables, gone: np.ndarray, new: dict[str, np.ndarray]) -> Tables:
    """The tables without the trips ``gone`` and with the connections ``new``, at stops that ``t`` knows."""
    stays = ~np.isin(t.trips, gone)[t.trip]
    old = {"from_stop": t.stops[t.start], "to_stop": t.stops[t.end], "trip": t.trips[t.trip], "seq": t.seq, "dep": t.dep, "arr": t.arr}
    return _arranged({k: np.concatenate([x[stays], new[k]]).astype(x.dtype) for k, x in old.items()}, t.stops, t.walk_at, t.walk_to, t.walk_w)


def _walked(t: Tables, label: np.ndarray) -> np.ndarray:
    """The least minute of walking once from each stop that has a label."""
    out = np.full(len(t.stops), NEVER)
    here = np.flatnonzero(label < NEVER)
    n = t.walk_at[here + 1] - t.walk_at[here]
    rows = np.repeat(t.walk_at[here] - np.cumsum(n) + n, n) + np.arange(n.sum())
    np.minimum.at(out, t.walk_to[rows], np.repeat(label[here], n) + t.walk_w[rows])
    return out


def _rounds(t: Tables, src: int, minute: int, span: slice, boardings: int | None, board: np.ndarray) -> np.ndarray:
    """Labels of all stops by the connections of ``span``; ``board`` is blank and left so."""
    label = np.full(len(t.stops), NEVER)
    label[src] = minute
    label = np.minimum(label, _walked(t, label))
    start, end, trip, seq, dep, arr = (x[span] for x in (t.start, t.end, t.trip, t.seq, t.dep, t.arr))
    k = 0
    while boardings is None or k < boardings:
        on = np.flatnonzero(dep >= label[start])
        np.minimum.at(board, trip[on], seq[on])
        ride = np.flatnonzero(seq >= board[trip])
        board[trip[on]] = NEVER
        new = np.full(len(t.stops), NEVER)
        np.minimum.at(new, end[ride], arr[ride])
        new = np.minimum(label, np.minimum(new, _walked(t, new)))
        if (new == label).all():
            break
        label, k = new, k + 1
    return label


def multi_pass(t: Tables, src: int, dst: int | None, minute: int, boardings: int | None, board: np.ndarray) -> np.ndarray:
    """Exact labels: that of ``dst`` is right, or all are where it is None."""
    n, reach = len(t.dep), HORIZON
    first = int(np.searchsorted(t.dep, minute)) if t.in_order else 0
    while True:
        last = n if dst is None or not t.in_order else int(np.searchsorted(t.dep, minute + reach))
        label = _rounds(t, src, minute, slice(first, last), boardings, board)
        if last >= n or label[dst] <= minute + reach:
            return label
        reach *= 2


def single_pass(t: Tables, src: int, dst: int, minute: int) -> np.ndarray:
    """One scan in order of departure; a walk only follows a strict improvement by a ride."""
    label = np.full(len(t.stops), NEVER)
    label[src] = minute
    label = np.minimum(label, _walked(t, label))
    on, best = set(), int(label[dst])
    for k in range(int(np.searchsorted(t.dep, minute)), len(t.dep)):
        if t.dep[k] >= best:
            break
        if t.trip[k] not in on and t.dep[k] < label[t.start[k]]:
            continue
        on.add(t.trip[k])
        stop, at = t.end[k], t.arr[k]
        if at < label[stop]:
            label[stop] = at
            walks = slice(t.walk_at[stop], t.walk_at[stop + 1])
            label[t.walk_to[walks]] = np.minimum(label[t.walk_to[walks]], at + t.walk_w[walks])
            if stop == dst:
                best = int(at)
    return label


def hold(conn: DataFrame, walks: DataFrame) -> Broadcast | None:
    """The timetable's arrays on the executors, or None if it is larger than ``MOST``."""
    return conn.sparkSession.sparkContext.broadcast(tables(conn, walks)) if fits(conn, walks) else None


def _held(conn: DataFrame, walks: DataFrame) -> Broadcast:
    held = hold(conn, walks)
    if held is None:
        raise ValueError(f"more than {MOST} connections or walks cannot be held by each task; arrivals.earliest and arrivals.labels search by rounds")
    return held


def _answers(t: Tables, asked: list[tuple], max_boardings: int | None, mode: str) -> list[int | None]:
    board = np.full(len(t.trips), NEVER)
    place = {int(s): k for k, s in enumerate(t.stops)}
    out = []
    for src, dst, minute in asked:
        a, z = place.get(src), place.get(dst)
        if a is None or z is None or minute is None:
            out.append(minute if src == dst and src is not None else None)
            continue
        label = multi_pass(t, a, z, minute, max_boardings, board) if mode == "multi_pass" else single_pass(t, a, z, minute)
        out.append(int(label[z]) if label[z] < NEVER else None)
    return out


def earliest(conn: DataFrame, walks: DataFrame, od: DataFrame, max_boardings: int | None = None, mode: str = "multi_pass", held: Broadcast | None = None) -> DataFrame:
    """``(q_id, src, dst, t_dep, ea)`` as :func:`.arrivals.earliest`; a stop unknown to the timetable is reached from itself only.

    ``held`` is what :func:`hold` gave for the timetable; without it, a timetable that is too large raises.
    """
    if mode not in ("multi_pass", "single_pass"):
        raise ValueError(f"no such mode: {mode}")
    spark = conn.sparkSession
    held = held or _held(conn, walks)
    schema = "q_id int, src int, dst int, t_dep int, ea int"

    def run(batches):
        for b in batches:
            out = _answers(held.value, list(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)), max_boardings, mode)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(out, pa.int32())], ["q_id", "src", "dst", "t_dep", "ea"])

    asked = od.select(*[F.col(c).cast("int").alias(c) for c in ("q_id", "src", "dst", "t_dep")])
    return asked.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, schema)


def earliest_overlaid(held: Broadcast, od: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame | None:
    """``(edit_set, q_id, src, dst, t_dep, ea)`` for ``od(edit_set, ...)``: the timetable is held once, whatever the number of sets.

    A set is what its trips ``gone(edit_set, trip)`` and its connections ``new(edit_set, ...)``
    make of the timetable; a task puts together one set's tables at a time.  None if the sets'
    rows are more than ``MOST``.
    """
    spark = od.sparkSession
    if gone.count() > MOST or new.count() > MOST:
        return None
    columns = ("edit_set", "trip", "seq", "from_stop", "to_stop", "dep", "arr")
    rows = new.select(*[F.col(c).cast("int").alias(c) for c in columns]).toArrow()
    rows = {c: rows.column(c).to_numpy() for c in columns}
    away = gone.select("edit_set", "trip").toArrow()
    away = {c: away.column(c).to_numpy() for c in away.column_names}
    sets = spark.sparkContext.broadcast((away, rows))

    def run(batches):
        last, t = None, None
        for b in batches:
            if b.num_rows == 0:
                continue
            number = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(number, prepend=number[:1] - 1)).tolist()
            for begin, end in zip(cuts, [*cuts[1:], len(number)], strict=True):
                if t is None or number[begin] != last:
                    last, (out, put) = number[begin], sets.value
                    own = put["edit_set"] == last
                    t = overlaid(held.value, out["trip"][out["edit_set"] == last], {c: x[own] for c, x in put.items()})
                part = b.slice(begin, end - begin)
                ea = _answers(t, list(zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True)), None, "multi_pass")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ea, pa.int32())], ["edit_set", "q_id", "src", "dst", "t_dep", "ea"])

    asked = od.select(*[F.col(c).cast("int").alias(c) for c in ("edit_set", "q_id", "src", "dst", "t_dep")])
    # ranges of sets and queries: a task has a few sets, and a set of many queries many tasks
    asked = asked.repartitionByRange(spark.sparkContext.defaultParallelism, "edit_set", "q_id").sortWithinPartitions("edit_set", "q_id")
    return asked.mapInArrow(run, "edit_set int, q_id int, src int, dst int, t_dep int, ea int")


def one_to_all(conn: DataFrame, walks: DataFrame, od: DataFrame, held: Broadcast | None = None) -> DataFrame:
    """``(q_id, stop, t)``: the earliest minute at each stop that a query reaches.

    Without ``held`` the size is not looked at: ``arrivals.reach_all`` is the switch.
    """
    spark = conn.sparkSession
    held = held or spark.sparkContext.broadcast(tables(conn, walks))

    def run(batches):
        t = held.value
        board = np.full(len(t.trips), NEVER)
        place = {int(s): k for k, s in enumerate(t.stops)}
        for b in batches:
            for q, src, minute in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if src in place and minute is not None:
                    label = multi_pass(t, place[src], None, minute, None, board)
                    got = np.flatnonzero(label < NEVER)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), q, np.int32)), pa.array(t.stops[got].astype(np.int32)), pa.array(label[got])], ["q_id", "stop", "t"])

    asked = od.select("q_id", "src", "t_dep").repartition(spark.sparkContext.defaultParallelism)
    return asked.mapInArrow(run, "q_id int, stop int, t int")
