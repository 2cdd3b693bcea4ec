"""Captures of live feeds as a stream of files: line status and vehicle delays by windows of event time.

A capture is one answer of a feed: when it was taken, of what kind it is and its text.  A file
that is delivered twice counts once, as long as its second copy comes within the lateness
allowed; captures later than that are left out.  A window is written once, when no capture of
it can come any more, so the tables below ``out`` only grow.  Statuses that change are followed
line by line in a state of one row a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import reports as P

SCHEMA = "capture_id long, captured_at timestamp, kind string, body string"
STATUS, VEHICLES = "status", "siri"
#: Severities from this one on are a good service.
GOOD = 10
#: Spells of a frame at most.
SPELLS = 10_000
EPISODES = "line string, severity int, began timestamp, ended timestamp, polls long"


def read(spark: SparkSession, path: str, files: int | None = None, late: str = "30 minutes") -> DataFrame:
    """A stream of captures, each once; those more than ``late`` behind the latest are left out."""
    reader = spark.readStream.schema(SCHEMA)
    rows = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)
    return rows.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["capture_id"])


def _window(minutes: int) -> Column:
    return F.window("captured_at", f"{minutes} minutes")


def statuses(captures: DataFrame) -> DataFrame:
    """``(captured_at, line, severity)`` of the status captures, in a stream or not."""
    kept = captures.where(F.col("kind") == STATUS)
    kind = "array<struct<id: string, lineStatuses: array<struct<statusSeverity: int>>>>"
    lines = kept.select("captured_at", F.explode(F.from_json("body", kind)).alias("l"))
    return lines.select("captured_at", F.col("l.id").alias("line"), F.get("l.lineStatuses", F.lit(0)).getField("statusSeverity").alias("severity"))


def status_windows(captures: DataFrame, minutes: int = 60) -> DataFrame:
    """``(began, line, polls, disrupted, worst)``: reports of each line in each window, and those of a disruption."""
    per = statuses(captures).groupBy(_window(minutes).alias("w"), "line").agg(F.count("severity").alias("polls"), F.count_if(F.col("severity") < GOOD).alias("disrupted"), F.min("severity").alias("worst"))
    return per.select(F.col("w.start").alias("began"), "line", "polls", "disrupted", "worst")


def delay_windows(captures: DataFrame, minutes: int = 60) -> DataFrame:
    """``(began, captures, vehicles, delays, minutes, most)``: vehicles and their delays in each window."""
    parsed = captures.where(F.col("kind") == VEHICLES).select("captured_at", P.siri_columns()[0].alias("v"), P.siri_columns()[1].alias("d"))
    total = F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x)
    per = parsed.groupBy(_window(minutes).alias("w")).agg(F.count("*").alias("captures"), F.sum("v").cast("long").alias("vehicles"), F.sum(F.size("d")).cast("long").alias("delays"), F.sum(total).cast("long").alias("minutes"), F.max(F.array_max("d")).alias("most"))
    return per.select(F.col("w.start").alias("began"), "captures", "vehicles", "delays", "minutes", "most")


def _follow(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Episodes of one line that end with these reports; the open one is the state."""
    held = list(state.get) if state.exists else None  # severity, began, last, polls
    if state.hasTimedOut:
        state.remove()
        yield _episode(key[0], held)
        return
    # numbers only: a report is 12 bytes, and a spell that ends a place in four arrays
    parts = [(b["captured_at"].to_numpy("datetime64[us]").astype("int64"), b["severity"].to_numpy("int32")) for b in rows]
    at, severity = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((severity, at))
    at, severity = at[order], severity[order]
    old = 0 if held is None else int(np.searchsorted(at, held[2]))
    if old:
        held[3] += int((severity[:old] == held[0]).sum())  # older than the last report: they cannot begin another episode
        at, severity = at[old:], severity[old:]
    if len(at):
        first = np.flatnonzero(np.diff(severity, prepend=severity[0] - 1))  # where runs of one severity begin
        began, of, polls = at[first], severity[first], np.diff(first, append=len(at))
        if held is not None and held[0] == of[0]:
            began[0], polls[0] = held[1], polls[0] + held[3]
        elif held is not None:
            began, of, polls = np.append(held[1], began), np.append(np.int32(held[0]), of), np.append(held[3], polls)
        held = [int(of[-1]), int(began[-1]), int(at[-1]), int(polls[-1])]
    state.update(tuple(held))
    state.setTimeoutTimestamp(max(held[2] // 1000, state.getCurrentWatermarkMs()) + 24 * 3_600_000)
    if len(at):
        for k in range(0, len(of) - 1, SPELLS):
            end = min(k + SPELLS, len(of) - 1)
            when = began[k : end + 1].astype("datetime64[us]")  # a spell ends where the next one begins
            yield pd.DataFrame({"line": key[0], "severity": of[k:end], "began": when[:-1], "ended": when[1:], "polls": polls[k:end]})


def _episode(line: str, held: list) -> pd.DataFrame:
    return pd.DataFrame({"line": [line], "severity": [held[0]], "began": [pd.Timestamp(held[1], unit="us")], "ended": [pd.Timestamp(held[2], unit="us")], "polls": [held[3]]})


def episodes(captures: DataFrame) -> DataFrame:
    """``(line, severity, began, ended, polls)``: spells of one severity, each when it ends.

    A spell ends with the first report of another severity, or with its last one where the
    line is silent for a day.  Reports are taken in order of time within a batch.
    """
    rows = statuses(captures).where("severity is not null and line is not null")
    return rows.groupBy("line").applyInPandasWithState(_follow, EPISODES, "severity int, began long, last long, polls long", "append", GroupStateTimeout.EventTimeTimeout)


def collect(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to Parquet files at ``out``, each once whatever fails in between."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
