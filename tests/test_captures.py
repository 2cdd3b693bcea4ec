"""Feed captures as a stream: late and repeated files, restarts, spells of severity."""

import datetime as dt

from pyspark.sql import functions as F

from stopgraph.streaming import captures as V

T0 = dt.datetime(2025, 1, 3, 7)


def _status(i, minute, *lines):
    body = "[" + ",".join(f'{{"id":"{n}","lineStatuses":[{{"statusSeverity":{s}}},{{"statusSeverity":1}}]}}' for n, s in lines) + "]"
    return (i, T0 + dt.timedelta(minutes=minute), V.STATUS, body)


def _siri(i, minute, vehicles, *delays):
    return (i, T0 + dt.timedelta(minutes=minute), V.VEHICLES, "<VehicleActivity>" * vehicles + "".join(f"<Delay>PT{d}M</Delay>" for d in delays))


FILES = [
    [_status(1, 0, ("red", 10), ("blue", 5)), _status(2, 20, ("red", 4)), _siri(3, 5, 2, 7, 9), (4, None, V.STATUS, "[]")],
    [_status(2, 20, ("red", 4)), _status(5, 70, ("red", 4), ("blue", 5)), _siri(6, 70, 1), (7, T0 + dt.timedelta(minutes=71), V.STATUS, "not json"), (8, T0 + dt.timedelta(minutes=72), V.STATUS, None)],
    [_status(9, 50, ("blue", 10)), _status(10, 130, ("red", 10)), _siri(11, 55, 3, 1)],  # 9 and 11 are late, within half an hour
    [_status(12, 40, ("red", 0)), _status(13, 300, ("red", 10), ("blue", 5))],  # 12 comes too late
    [_status(14, 2000, ("red", 10))],
]


def _run(spark, folder, of, name):
    rows = of(V.read(spark, f"{folder}/files", 1))
    V.collect(rows, f"{folder}/{name}", f"{folder}/{name}-offsets").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")


def _put(spark, folder, rows):
    spark.createDataFrame(rows, V.SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/files")


def test_windows_late_repeated_and_restarted(spark, tmp_path):
    folder = str(tmp_path)
    minute = lambda c: ((F.unix_timestamp(c) - F.lit(int(T0.replace(tzinfo=dt.UTC).timestamp()))) / 60).cast("int")
    for k, rows in enumerate(FILES):  # a run a file: each goes on where the last one stopped
        _put(spark, folder, rows)
        got = _run(spark, folder, V.status_windows, "status")
        if k == 0:
            assert got.count() == 0  # no window is over yet
    got = sorted(tuple(r) for r in got.withColumn("began", minute("began")).collect())
    # the window of 07:00 holds captures 1, 2 (once) and the late 9, not 12
    assert got == [(0, "blue", 2, 1, 5), (0, "red", 2, 1, 4), (60, "blue", 1, 1, 5), (60, "red", 1, 1, 4), (120, "red", 1, 0, 10), (300, "blue", 1, 1, 5), (300, "red", 1, 0, 10)]
    delays = _run(spark, folder, V.delay_windows, "delays")  # all files in one run, batch by batch
    assert sorted(tuple(r) for r in delays.withColumn("began", minute("began")).collect()) == [(0, 2, 5, 3, 17, 9), (60, 1, 1, 0, 0, None)]


def test_spells(spark, tmp_path):
    folder = str(tmp_path)
    for rows in FILES:
        _put(spark, folder, rows)
    got = sorted((r.line, r.severity, (r.began - T0).total_seconds() // 60, (r.ended - T0).total_seconds() // 60, r.polls) for r in _run(spark, folder, V.episodes, "spells").collect())
    # blue was 5 at 0 and 70; the late 10 of minute 50 begins no spell; blue is silent for a day after 300
    assert got == [("blue", 5, 0, 300, 3), ("red", 4, 20, 130, 2), ("red", 10, 0, 20, 1)]
