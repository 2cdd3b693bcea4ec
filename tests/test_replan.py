"""Answers that change with a stream of edits, against answers of the edited timetable."""

import random

import pytest

from stopgraph.operators import arrivals as A
from stopgraph.operators import edits as E
from stopgraph.streaming import edit_stream as S
from stopgraph.streaming import replan as N

CONN = "trip int, seq int, from_stop int, to_stop int, dep int, arr int, route_int int, mode int"


@pytest.fixture(scope="module")
def city(spark, tmp_path_factory):
    rng, rows = random.Random(12), []
    for trip in range(120):
        t, stop = rng.randint(0, 300), rng.randrange(14)
        for seq in range(rng.randint(2, 5)):
            ride, to = rng.randint(2, 15), rng.randrange(14)
            rows.append((trip, seq, stop, to, t, t + ride, trip % 9, 0))
            t, stop = t + ride + rng.randint(0, 3), to
    path = str(tmp_path_factory.mktemp("city") / "conn")
    spark.createDataFrame(rows, CONN).write.parquet(path)
    walks = spark.createDataFrame([(u, (u + 3) % 14, 4) for u in range(0, 14, 3)], "u int, v int, w int")
    od = spark.createDataFrame([(q, rng.randrange(14), rng.randrange(14), rng.randint(0, 250)) for q in range(50)], "q_id int, src int, dst int, t_dep int")
    return spark.read.parquet(path), walks, od


def _edit(i, kind, trip=None, delta=None, template=None, start=None):
    return (i, None, i, kind, trip, delta, template, start)


BATCHES = [
    [_edit(10, "CANCELLATION", 3), _edit(11, "DELAY", 8, 7), _edit(12, "CANCELLATION", 20)],
    [_edit(20, "ADDITION", template=5, start=40), _edit(21, "DELAY", 8, -4), _edit(22, "DELAY", 999, 5)],
    [],
    [_edit(30, "RESTORE", 3), *(_edit(100 + k, "CANCELLATION", k) for k in range(40, 80)), _edit(21, "DELAY", 8, -4)],
    # late: before all others in order, and an added trip that takes the first number
    [_edit(1, "CANCELLATION", 8), _edit(2, "ADDITION", template=11, start=5), _edit(3, "RESTORE", 20), _edit(31, "DELAY", 44, 9)],
]


def test_each_batch(spark, city, tmp_path):
    conn, walks, od = city
    folder, seen = str(tmp_path / "out"), []
    for k, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, S.SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/edits")
        N.replan(S.read(spark, f"{folder}/edits", 1), conn, walks, od, folder, f"{folder}/offsets").awaitTermination()
        seen += [r for r in rows if r[0] not in {s[0] for s in seen}]
        log = spark.createDataFrame([(0, r[2], r[3], r[4], r[5], r[6], r[7], True) for r in seen], E.EDIT_SCHEMA)
        want = sorted(tuple(r) for r in A.answer(E.apply_edits(conn, log), walks, od).collect())
        assert sorted(tuple(r) for r in N.answers(spark, folder).collect()) == want, k
    rows = N.changes(spark, folder).collect()
    assert all(r.old_ea != r.ea for r in rows) and {r.batch for r in rows} >= {0, 3} and 2 not in {r.batch for r in rows}
    before = {r.q_id: r.ea for r in N.answers(spark, folder, 0).collect()}
    for r in sorted(rows):  # each change starts from the answer that stood
        assert before[r.q_id] == r.old_ea
        before[r.q_id] = r.ea

    # a batch that runs again leaves the same changes, also after later ones
    held = sorted(tuple(r) for r in rows)
    for k in (3, 0):
        N.answer_batch(conn, walks, folder, k)
    assert sorted(tuple(r) for r in N.changes(spark, folder).collect()) == held


def test_only_queries_in_reach_are_answered(spark, city):
    conn, walks, od = city
    standing = A.answer(conn, walks, od)
    gone, come = E.delta(conn, None, spark.createDataFrame([(0, 1, "DELAY", 8, 7, None, None, True)], E.EDIT_SCHEMA))
    minutes = sorted({r.dep for r in gone.union(come).collect()})
    want = sorted(r.q_id for r in standing.collect() if any(r.t_dep <= m and (r.ea is None or m < r.ea) for m in minutes))
    got = sorted(r.q_id for r in N.touched(standing, gone, come).collect())
    assert got == want and 0 < len(got) < od.count()


def test_delta(spark, city):
    conn, _, _ = city
    one = spark.createDataFrame([(0, 1, "DELAY", 8, 7, None, None, True), (0, 2, "CANCELLATION", 9, None, None, None, True)], E.EDIT_SCHEMA)
    two = one.union(spark.createDataFrame([(0, 3, "RESTORE", 9, None, None, None, True), (0, 4, "ADDITION", None, None, 5, 33, True)], E.EDIT_SCHEMA))
    for before, after in ((None, one), (one, two), (two, one), (two, two)):
        old, new = (conn if e is None else E.apply_edits(conn, e) for e in (before, after))
        gone, come = E.delta(conn, before, after)
        assert sorted(gone.collect()) == sorted(old.exceptAll(new).collect())
        assert sorted(come.collect()) == sorted(new.exceptAll(old).collect())
    none = conn.where("false")
    assert [x.count() for x in E.delta(none, None, two)] == [0, 0]
