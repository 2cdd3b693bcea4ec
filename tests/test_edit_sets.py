"""Edit sets side by side, strict edits, phases, late edits of a stream, generators."""

import pytest
from pyspark.sql import functions as F
from test_timetable import CONN, OD

from stopgraph.operators import arrivals, edits, relational, reports
from stopgraph.streaming import edit_stream

ROWS = [(1, 0, 0, 1, 0, 5, 0, 0), (1, 1, 1, 2, 6, 9, 0, 0), (2, 0, 0, 1, 10, 15, 0, 0), (3, 0, 0, 1, 20, 25, 0, 1)]


@pytest.fixture(scope="module")
def conn(spark):
    return spark.createDataFrame(ROWS, CONN)


def _edits(spark, *rows):
    return spark.createDataFrame([(*r, *(None,) * (7 - len(r)), True) for r in rows], edits.EDIT_SCHEMA)


def _times(df):
    return sorted((r.trip, r.seq, r.dep) for r in df.collect())


def test_sets_do_not_mix(spark, conn):
    both = _edits(spark, (0, 1, "DELAY", 1, 2), (1, 1, "DELAY", 1, 3), (1, 2, "CANCELLATION", 2), (1, 3, "ADDITION", None, None, 3, 50), (0, 9, "ADDITION", None, 7, 3))
    got = edits.apply_edit_sets(conn, both, spark.createDataFrame([(0,), (1,), (2,)], "edit_set int"))
    assert _times(got.where("edit_set = 0")) == [(1, 0, 2), (1, 1, 8), (2, 0, 10), (3, 0, 20), (4, 0, 27)]
    assert _times(got.where("edit_set = 1")) == [(1, 0, 3), (1, 1, 9), (3, 0, 20), (4, 0, 50)]
    assert _times(got.where("edit_set = 2")) == _times(conn)
    walks = spark.createDataFrame([], "u int, v int, w int, edit_set int")
    od = spark.createDataFrame([(k, q, 0, 1, t) for k in range(3) for q, t in ((0, 1), (1, 26))], "edit_set int, q_id int, src int, dst int, t_dep int")
    after = arrivals.answer_worlds(got, walks, od, "edit_set", 3)
    assert {(r.edit_set, r.q_id): r.ea for r in after.collect()} == {(0, 0): 7, (0, 1): 32, (1, 0): 8, (1, 1): 55, (2, 0): 15, (2, 1): None}
    before = od.select("edit_set", "q_id", F.when(F.col("q_id") == 0, 15).alias("ea"))
    delta = {r.edit_set: r.asDict() for r in reports.quality_delta(reports.compare(before, after), ["edit_set"]).collect()}
    assert (delta[0]["n_better"], delta[0]["n_became_reachable"], delta[0]["median_abs_delta"]) == (2, 1, 8.0) and delta[2]["n_changed"] == 0


def test_phases_and_large_positions(spark, conn):
    late = _edits(spark, (0, 5_000_000, "DELAY", 1, 4), (0, 3, "CANCELLATION", 1), (0, 2_000_000_000, "DELAY", 2, 1))
    assert _times(edits.apply_phases(conn, late)) == [(2, 0, 11), (3, 0, 20)]
    many = _edits(spark, *[(0, 1000 * k, "ADDITION", None, None, 3, 30 + k) for k in range(40)])
    assert [r.dep for r in edits.apply_edits(conn, many).where("trip > 3").orderBy("trip").collect()] == [30 + k for k in range(40)]


def test_strict_edits(spark, conn):
    bad = _edits(spark, (0, 1, "DELAY", 3, 40), (0, 2, "CANCELLATION", 9), (0, 3, "ADDITION", None, None, 1, 55), (0, 4, "DELAY", 1, 3))
    assert {(r.pos, r.reason) for r in edits.refused(conn, bad, 0, 60).collect()} == {(1, "out of range"), (2, "unknown trip"), (3, "out of range")}
    with pytest.raises(ValueError, match="DELAY of trip 3: out of range"):
        edits.apply_strictly(conn, bad, 0, 60)
    assert _times(edits.apply_strictly(conn, bad.where("pos = 4"), 0, 60))[0] == (1, 0, 3)
    counts = edits.batch_counts(conn, bad).first()
    assert (counts.n_edits, counts.n_delay, counts.n_unknown, counts.n_trips) == (4, 2, 1, 2)
    back = _edits(spark, (0, 1, "ADDITION", None, None, 1, 30), (0, 2, "ADDITION", None, None, 2, 40), (0, 3, "CANCEL_ADDED", 4))
    assert [t for t in _times(edits.apply_edits(conn, back)) if t[0] > 3] == [(5, 0, 40)]


def test_generators(spark, conn):
    for kind in ("DELAY", "CANCELLATION", "ADDITION"):
        made = edits.build_edit_set(conn, kind, 1, 7, 4)
        assert made.columns == [c.split()[0] for c in edits.EDIT_SCHEMA.split(", ")] and made.count() == 1
        assert made.first().edit_set == 4 and edits.refused(conn, made, -5, 800).count() == 0
    with pytest.raises(ValueError):
        edits.build_edit_set(conn, "OTHER", 1, 7)
    assert edits.sample_trips(conn, 3, 1).count() == 3


def test_routes_of_edited_trips(spark, conn):
    stops, times = relational.route_tables(edits.apply_edits(conn, _edits(spark, (0, 1, "DELAY", 1, 2), (0, 2, "CANCELLATION", 3))))
    assert sorted(map(tuple, stops.collect())) == [(0, 0, 0), (0, 1, 1), (0, 2, 2)]
    assert sorted((r.trip, r.pos, r.arr, r.dep) for r in times.collect()) == [(1, 0, None, 2), (1, 1, 7, 8), (1, 2, 11, None), (2, 0, None, 10), (2, 1, 15, None)]


def test_late_and_repeated_edits_reach_the_log(spark, tmp_path):
    schema = "edit_id long, ts timestamp, pos int, edit_type string, trip_id int, delta_min int, template_trip_id int, start_minute int"
    row = lambda i, ts, pos, kind, trip, d=None: (i, ts, pos, kind, trip, d, None, None)
    files = [[row(1, "2025-01-03 12:00:00", 1, "DELAY", 1, 2), row(2, "2025-01-03 13:00:00", 3, "DELAY", 2, 1)], [row(3, "2025-01-03 08:00:00", 2, "CANCELLATION", 3), row(1, "2025-01-03 12:00:00", 1, "DELAY", 1, 2)]]
    for rows in files:
        cast = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
        cast.write.mode("append").parquet(str(tmp_path / "in"))
        edit_stream.append_log(edit_stream.read(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    log = edit_stream.log_edits(spark, str(tmp_path / "log"))
    assert sorted((r.pos, r.edit_type) for r in log.collect()) == [(1, "DELAY"), (2, "CANCELLATION"), (3, "DELAY")]
    assert _times(edits.apply_edits(spark.createDataFrame(ROWS, CONN), log)) == [(1, 0, 2), (1, 1, 8), (2, 0, 11)]
    counted = {r.batch: (r.n_edits, r.n_delay, r.n_cancellation) for r in edit_stream.batches(spark, str(tmp_path / "log")).collect()}
    assert counted == {0: (2, 2, 0), 1: (2, 1, 1)}


def test_replay(spark):
    trips = spark.range(50).select(F.col("id").cast("int").alias("trip_no"), (F.col("id") * 3).cast("int").alias("trip"))
    rows = edit_stream.replay(trips, 5000, 1).collect()
    assert len(rows) == 5000 and [r.t_offset_sec for r in rows] == sorted(r.t_offset_sec for r in rows)
    late = sorted(r.delay_min for r in rows if r.op_type == "delay")
    assert 0.83 < len(late) / 5000 < 0.87 and late[0] == 1 and late[-1] == 30 and 3 <= late[len(late) // 2] <= 4
    busy = sum(7 * 3600 <= r.t_offset_sec < 10 * 3600 for r in rows) / 5000
    assert abs(busy - 9.0 / (5 * 0.3 + 13 * 1 + 3 * 3 + 3 * 3.5)) < 0.03


def test_medians_of_resamples(spark):
    rows = spark.createDataFrame([(k, float(k % 10)) for k in range(200)], "pos long, value double")
    got = reports.bootstrap(rows, "value", 200, 3).first()
    assert got.median == 4.5 and 3 <= got.low <= 4.5 <= got.high <= 6


def test_unsound_connections_are_refused(spark, conn):
    reports.require_sound(conn)
    for bad in ((5, 0, 0, 0, 1, 2, 0, 0), (5, 0, 0, 1, 2000, 3, 0, 0), (1, 2, 2, 3, 1, 4, 0, 0)):
        with pytest.raises(ValueError):
            reports.require_sound(conn.union(spark.createDataFrame([bad], CONN)))
    got = reports.validation(conn.union(spark.createDataFrame([(6, 0, 0, 1, 1430, 10, 0, 0)], CONN))).first()
    assert (got.n_inversions, got.n_overnight, got.n_wrap_errors) == (1, 1, 0)


def test_kinds_of_overtaking(spark):
    st = "trip int, seq int, stop int, arr int, dep int, route_int int, mode int"
    rows = [(1, 0, 0, 0, 0, 0, 0), (1, 1, 1, 50, 51, 0, 0), (2, 0, 0, 5, 5, 0, 0), (2, 1, 1, 40, 60, 0, 0)]  # passed on the way
    rows += [(3, 0, 0, 0, 0, 1, 0), (3, 1, 1, 50, None, 1, 0), (4, 0, 0, 5, 5, 1, 0), (4, 1, 1, 40, 41, 1, 0)]  # no departure
    rows += [(5, 0, 0, 0, 0, 2, 0), (5, 1, 1, 50, 900, 2, 0), (6, 0, 0, 5, 5, 2, 0), (6, 1, 1, 40, 41, 2, 0)]  # a day part apart
    rows += [(7, 0, 0, 0, 0, 3, 0), (7, 1, 1, 50, 70, 3, 0), (8, 0, 0, 5, 5, 3, 0), (8, 1, 1, 40, 60, 3, 0)]  # later in both
    found = relational.fifo_adjacent(spark.createDataFrame(rows, st))
    assert {r.route_int: r.kind for r in found.collect()} == {0: "overtaking", 1: "nat", 2: "wraparound", 3: "data_error"}
    assert relational.fifo_decision(found).first().decision == "block_reopen_stage_2"
    assert relational.fifo_decision(found.where("kind in ('nat', 'wraparound')")).first().decision == "proceed_with_note"
    assert relational.fifo_decision(found.where("false")).first().decision == "proceed"


def test_compaction(spark, conn, tmp_path):
    few, many = _edits(spark, (0, 1, "DELAY", 1, 2)), _edits(spark, (0, 1, "DELAY", 1, 2), (0, 2, "CANCELLATION", 2), (0, 3, "DELAY", 3, 1))
    assert edits.needs_compaction(conn, few, 0.5) is False and edits.needs_compaction(conn, many, 0.5) is True
    base = edits.compact(conn, many, str(tmp_path / "base"))
    assert _times(base) == _times(edits.apply_edits(conn, many)) == [(1, 0, 2), (1, 1, 8), (3, 0, 21)]
