"""Small timetables with edits and expected answers as JSON lines, keys in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "id string, connections array<struct<trip: int, seq: int, from_stop: int, to_stop: int, dep: int, arr: int>>, walks array<struct<u: int, v: int, w: int>>, "
    "edits array<struct<pos: int, edit_type: string, trip_id: int, delta_min: int, template_trip_id: int, start_minute: int>>, queries array<struct<src: int, dst: int, t_dep: int, ea: int>>"
)


def write(fixtures: DataFrame, path: str) -> None:
    """Fixtures of ``SCHEMA`` in order of their ids, one line each; nulls are written out."""
    fixtures.orderBy("id").coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
