"""Beyond the bound a timetable is written once: sets are laid over it, and rounds read ranges of it."""

from test_overlays import world  # noqa: F401

from stopgraph.operators import arrivals, local


def test_sets_beyond_the_bound_copy_no_timetable(spark, world, monkeypatch):  # noqa: F811
    conn, walks, od, log = world
    few, some = od.where("q_id < 4"), log.where("edit_set = 0")
    want = sorted(map(tuple, arrivals.answer_edit_sets(conn, walks, few, some, 1).collect()))
    monkeypatch.setattr(local, "MOST", 3)
    monkeypatch.delattr(arrivals, "answer_worlds")  # which copies the timetable once a set
    assert sorted(map(tuple, arrivals.answer_edit_sets(conn, walks, few, some, 1).collect())) == want
