"""Raw feeds, kept tables, fixtures as files."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_timetable import CONN, FIXTURES, OD

from stopgraph.operators import local
from stopgraph.sources import cache, fixtures, timetable


def _stop_times(spark, rows):
    made = spark.createDataFrame(rows, "trip_id string, stop_sequence int, stop_int int, arrival string, departure string, route_int int, Mode string")
    at = lambda c: F.to_timestamp(F.concat(F.lit("2025-01-03 "), F.col(c))).alias(f"{c}_time")
    return made.select("trip_id", "stop_sequence", "stop_int", F.lit("x").alias("stop_name"), F.lit(0.0).alias("stop_lat"), F.lit(0.0).alias("stop_lon"), at("arrival"), at("departure"), "route_int", "Mode")


FEED = [
    ("b", 1, 0, "07:05:30", "07:06:00", 1, "bus"), ("b", 2, 1, "07:10:00", "07:10:00", 1, "bus"), ("b", 3, 1, "07:11:00", "07:12:59", 1, "bus"), ("b", 4, 2, "07:20:00", "07:20:00", 1, "bus"),
    ("a", 1, 2, "07:30:00", "07:30:00", 2, "Tram"), ("a", 2, 3, None, None, 2, "Tram"), ("a", 3, 4, "07:50:00", "07:50:00", 2, "Tram"), ("a", 4, 5, "07:55:00", "07:55:00", 2, "Tram"),
    ("early", 1, 0, "06:58:30", "06:59:30", 1, "bus"), ("early", 2, 1, "07:01:00", "07:01:00", 1, "bus"),
]


def test_feed(spark, tmp_path):
    _stop_times(spark, FEED).write.parquet(str(tmp_path / "stop_times"))
    spark.createDataFrame([(2, 6, 61), (6, 7, 600), (7, 8, 300)], "u int, v int, walk_seconds int").write.parquet(str(tmp_path / "footpaths"))
    spark.createDataFrame([(0, 0, 2, 0), (1, 0, 7, 0), (2, 0, 1, -5)], OD).write.parquet(str(tmp_path / "od"))
    t = timetable.load_feed(spark, str(tmp_path))
    # runs of one stop are one, times round down, missing times leave a gap, before seven is outside
    rows = sorted((r.trip, r.from_stop, r.to_stop, r.dep, r.arr, r.mode) for r in t.connections.collect())
    assert rows == [(0, 4, 5, 50, 55, 2), (1, 0, 1, 6, 10, 0), (1, 1, 2, 12, 20, 0)]
    assert sorted(map(tuple, t.walks.collect())) == [(2, 6, 2), (2, 7, 12), (6, 7, 10), (6, 8, 15), (7, 8, 5)]
    assert {r.q_id: r.ea for r in local.earliest(t.connections, t.walks, t.od).collect()} == {0: 20, 1: 32, 2: 10}
    some = timetable.load_feed(spark, str(tmp_path), stops=spark.createDataFrame([(0,), (1,), (6,), (7,)], "stop int"))
    assert some.connections.count() == 1 and [tuple(r) for r in some.walks.collect()] == [(6, 7, 10)]
    timetable.save(t, str(tmp_path / "kept"))
    again = timetable.load(spark, str(tmp_path / "kept"))
    assert sorted(map(tuple, again.connections.collect())) == sorted(map(tuple, t.connections.collect()))


def test_kept_tables_go_stale(spark, tmp_path):
    legs = spark.createDataFrame([(0, 1, 4), (1, 2, 5)], "u int, v int, w int")
    path, runs = str(tmp_path / "walks"), []
    build = lambda: runs.append(1) or legs.where("w < 5")
    for _ in range(2):
        assert cache.cached(build, spark, path, "walks", {"legs": legs}, {"cap": 5}).count() == 1
    assert len(runs) == 1  # the second reads what is there
    assert cache.load(spark, path, "walks", {"legs": legs.orderBy(F.desc("u")).repartition(3)}, {"cap": 5}).count() == 1
    with pytest.raises(cache.Stale, match="params"):
        cache.load(spark, path, "walks", {"legs": legs}, {"cap": 6})
    with pytest.raises(cache.Stale, match="source legs"):
        cache.load(spark, path, "walks", {"legs": legs.union(legs.limit(1))}, {"cap": 5})
    with pytest.raises(cache.Stale, match="source legs"):
        cache.cached(build, spark, path, "walks", {"legs": legs.withColumn("w", F.col("w") - 1)}, {"cap": 5})
    assert cache.cached(build, spark, path, "walks", {"legs": legs.withColumn("w", F.col("w") - 1)}, {"cap": 5}, refresh=True).count() == 1 and len(runs) == 2


def test_fixtures_as_files(spark, tmp_path):
    rows = []
    for k, (conn, walks, queries) in FIXTURES.items():
        rows.append((k, conn, walks, [], queries))
    rows.append(("F01", [(1, 0, 0, 1, 0, 5)], [], [(1, "DELAY", 1, 3, None, None)], [(0, 1, 0, 8)]))
    made = spark.createDataFrame(rows, fixtures.SCHEMA)
    fixtures.write(made, str(tmp_path / "fx"))
    back = fixtures.read(spark, str(tmp_path / "fx"))
    assert sorted(map(str, back.collect())) == sorted(map(str, made.collect()))
    for r in back.where("size(edits) = 0").collect():
        conn = spark.createDataFrame([(*c, 0, 0) for c in r.connections], CONN)
        assert conn.count() == len(r.connections)


def test_results_manifests_and_tags(spark, tmp_path):
    rows = spark.createDataFrame([(k, 0, 1, 0, None if k % 3 else k) for k in range(450)], OD + ", ea int").coalesce(1)
    timetable.write_results(rows, str(tmp_path / "out"))
    files = sorted(tmp_path.glob("out/*.csv"))
    assert len(files) >= 3 and all(len(f.read_text().splitlines()) <= 201 for f in files)
    listed = timetable.file_manifest(spark, str(tmp_path / "out")).collect()
    assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in listed if r.path.endswith("csv")} == {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in files}
    lines = {r.q_id: r.line for r in timetable.result_lines(rows).collect()}
    assert lines[3] == "3,0,1,0,3" and lines[4] == "4,0,1,0,None"
    (tmp_path / "q.csv").write_text("q_id,src,dst,t_dep\n1,2,3,4\nx,2,3,4\n")
    assert [tuple(r) for r in timetable.read_queries(spark, str(tmp_path / "q.csv")).collect()] == [(1, 2, 3, 4), (None, 2, 3, 4)]
    assert [timetable.dataset_tag(p) for p in ("/x/Full_City/data", "/d/berlin", "/NYC/x", "/data/my_town")] == ["full_london", "berlin", "nyc", "my_town"]
