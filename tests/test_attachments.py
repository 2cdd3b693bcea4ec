"""Where queries begin: every departure that can be boarded, and the first ones that a search starts from."""

from test_timetable import CONN, OD

from stopgraph.operators import relational


def test_all_departures_at_the_source(spark):
    rows = [(k, 0, 0, 1, dep, dep + 5, 0, 0) for k, dep in enumerate((5, 10, 20, 30))] + [(4 + k, 0, 2, 1, dep, dep + 5, 0, 0) for k, dep in enumerate((12, 14, 18))]
    conn, walks = spark.createDataFrame(rows, CONN), spark.createDataFrame([(0, 2, 4)], "u int, v int, w int")
    od = spark.createDataFrame([(0, 0, 1, 10)], OD)
    got = {r.trip for r in relational.source_attachment(od, conn, walks).collect()}
    assert got == {1, 2, 3, 5}
    assert {r.trip for r in relational.first_departures(od, conn, walks).collect()} == {1, 5}
