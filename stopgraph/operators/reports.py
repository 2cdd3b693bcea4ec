"""Comparisons, validation and statistics of results."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import draws
from ..functions.minutes import overnight_wrap
from ..sources.store import written
from .edits import draw


def compare(one: DataFrame, other: DataFrame) -> DataFrame:
    """``(q_id, a, b, verdict, delta)`` of two results; a side not reached counts 9999 away."""
    keys = [c for c in ("edit_set", "q_id") if c in one.columns and c in other.columns]
    both = one.select(*keys, F.col("ea").alias("a")).join(other.select(*keys, F.col("ea").alias("b")), keys, "full_outer")
    verdict = F.when(F.col("a").isNull() & F.col("b").isNull(), "both_unreachable").when(F.col("a") == F.col("b"), "match").when(F.col("a").isNull() | (F.col("b") < F.col("a")), "b_better").otherwise("a_better")
    delta = F.when(F.col("a").isNull() & F.col("b").isNull(), 0).when(F.col("a").isNull(), -9999).when(F.col("b").isNull(), 9999).otherwise(F.col("b") - F.col("a"))
    return both.select(*keys, "a", "b", verdict.alias("verdict"), delta.cast("int").alias("delta"))


def parity_counts(compared: DataFrame) -> DataFrame:
    return compared.agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("match", "both_unreachable", "a_better", "b_better")])


def quality_delta(compared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How a batch of answers changed: better, worse, newly reached or not, and by how much.

    A query newly reached is better, one no longer reached is worse; sizes are those of
    queries reached before and after, 0 where there is none.
    """
    a, b = F.col("a"), F.col("b")
    size = F.when(a.isNotNull() & b.isNotNull() & (a != b), F.abs(b - a))
    gained, lost = a.isNull() & b.isNotNull(), a.isNotNull() & b.isNull()
    return compared.groupBy(*(by or [])).agg(
        F.count_if(~a.eqNullSafe(b)).alias("n_changed"), F.count_if(gained | F.coalesce(b < a, F.lit(False))).alias("n_better"), F.count_if(lost | F.coalesce(b > a, F.lit(False))).alias("n_worse"),
        F.count_if(gained).alias("n_became_reachable"), F.count_if(lost).alias("n_became_unreachable"),
        F.coalesce(F.percentile(size, F.lit(0.5)), F.lit(0.0)).alias("median_abs_delta"), F.coalesce(F.max(size), F.lit(0)).cast("int").alias("max_abs_delta"),
    )


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    p = lambda q: F.percentile(value, F.lit(q))
    return rows.groupBy(by).agg(p(0.5).alias("median"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.count(value).alias("n"))


#: Rows up to which their places are looked up in each task, in two bytes a row; beyond, draws are joined with the rows.
MOST_LOOKED_UP = 100_000_000
#: Draws hashed at once, resamples of a task's piece of work, rows coded at once.
HASHED, RESAMPLES, CODED = 8192, 50, 1 << 18
BELOW, ABOVE = 0, 65535


def _medians_by_join(rows: DataFrame, value: str, resamples: int, seed: int) -> DataFrame:
    """``(r, m)``: each draw a row, joined with the row that it draws."""
    n = F.broadcast(rows.agg(F.count("*").alias("n")))  # one row
    draws = rows.select(F.col("pos").alias("i")).join(n, F.lit(True)).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    drawn = draws.select("r", F.floor(draw("r", "i", seed=seed) * F.col("n")).cast("long").alias("pos"))
    return drawn.join(rows.select(F.col("pos").cast("long").alias("pos"), value), "pos").groupBy("r").agg(F.percentile(value, F.lit(0.5)).alias("m"))


def _codes(rows: DataFrame, value: str, n: int, low: float, high: float, band: np.ndarray) -> list[bytes]:
    """Two bytes a row in order of ``pos``: below the ``band``, above it, or which of its values; packed by pieces."""

    def coded(key, part):
        code = np.full(min(CODED, n - int(key[0]) * CODED), ABOVE, np.uint16)
        v = part["v"].to_numpy()
        code[part["pos"].to_numpy() % CODED] = np.where(v < low, BELOW, np.where(v <= high, np.searchsorted(band, v) + 1, ABOVE))
        return pd.DataFrame({"piece": [key[0]], "body": [zlib.compress(code.tobytes(), 1)]})

    own = rows.select(F.floor(F.col("pos") / CODED).alias("piece"), F.col("pos").cast("long").alias("pos"), F.col(value).cast("double").alias("v"))
    packed = own.groupBy("piece").applyInPandas(coded, "piece long, body binary").collect()
    return [bytes(p.body) for p in sorted(packed, key=lambda p: p.piece)]


def _medians(rows: DataFrame, value: str, resamples: int, seed: int) -> DataFrame | None:
    """``(r, m)`` by counting: a draw below a narrow band around the median, or in it, is counted where it is drawn.

    A resample's median lies within the band of values around that of the rows, but for a
    chance in 10 ** 12; where one does not, where rows have no value, and where there are too
    many rows or values in the band, the answer is None.
    """
    spark = rows.sparkSession
    n, known = rows.agg(F.count("*"), F.count(value)).first()
    if not n or known < n or n > MOST_LOOKED_UP:
        return None
    near = min(0.5, 4 / math.sqrt(n))
    low, high = rows.agg(F.percentile_approx(F.col(value).cast("double"), [0.5 - near, 0.5 + near], 100_000)).first()[0]
    band = rows.select(F.col(value).cast("double").alias("v")).where(F.col("v").between(low, high)).distinct().limit(ABOVE).toArrow().column("v").to_numpy()
    if len(band) >= ABOVE - 1 or math.isnan(high):
        return None
    band = np.sort(band)
    held = spark.sparkContext.broadcast((_codes(rows, value, n, low, high, band), band))
    groups = -(-resamples // RESAMPLES)
    pieces = -(-n // HASHED) * groups

    def count(batches):
        packed, values = held.value
        code = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint16) for x in packed])
        for b in batches:
            for piece in b.column(0).to_pylist():
                first, out = piece // groups * HASHED, []
                for r in range(piece % groups * RESAMPLES + 1, min(resamples, (piece % groups + 1) * RESAMPLES) + 1):
                    drawn = code[np.floor(draws(seed, r, first, min(n, first + HASHED)) * n).astype(np.int64)]
                    which, times = np.unique(drawn[drawn != ABOVE], return_counts=True)
                    out.append((np.full(len(which), r), which, times))
                r, which, times = (np.concatenate(x) for x in zip(*out, strict=True))
                at = pa.array(values[np.maximum(which, 1) - 1], mask=which == BELOW)
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), at, pa.array(times.astype(np.int64))], ["r", "v", "times"])

    tasks = min(pieces, 8 * spark.sparkContext.defaultParallelism)
    counted = spark.range(0, pieces, 1, tasks).mapInArrow(count, "r int, v double, times long").groupBy("r", "v").agg(F.sum("times").alias("times"))
    upto = counted.withColumn("upto", F.sum("times").over(Window.partitionBy("r").orderBy(F.asc_nulls_first("v"))))  # values of the band
    first = lambda k: F.min_by("v", F.when(F.col("upto") > k, F.struct(F.col("upto"))))
    a, b = first((n - 1) // 2).alias("a"), first(n // 2).alias("b")
    medians = written(upto.groupBy("r").agg(a, b).select("r", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(0.5 * F.col("a") + 0.5 * F.col("b")).alias("m")), "medians")
    return medians if medians.where("m is not null").count() == resamples else None


def bootstrap(rows: DataFrame, value: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """The median of ``rows(pos, value)`` and the 2.5 and 97.5 percentiles of its resamples' medians.

    ``pos`` numbers the rows from 0.  Each resample draws as many rows as there are, with
    replacement, by a hash of the resample and the draw; draws are dealt over all tasks, and
    only those near the median leave theirs, as counts of values.
    """
    rows = written(rows, "sample")
    medians = _medians(rows, value, resamples, seed)
    if medians is None:
        medians = _medians_by_join(rows, value, resamples, seed)
    out = medians.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return rows.agg(F.percentile(value, F.lit(0.5)).alias("median")).join(out, F.lit(True))  # a row each


def validation(conn: DataFrame) -> DataFrame:
    """Counts that tell whether connections are sound; arrivals after midnight are not errors."""
    wrap = overnight_wrap(F.col("dep"), F.col("arr"))
    w = Window.partitionBy("trip").orderBy("seq")
    back = F.coalesce(F.col("dep") < F.lag("arr").over(w), F.lit(False))
    return conn.withColumn("back", back).agg(
        F.count("*").alias("n_rows"), F.countDistinct("trip").alias("n_trips"), F.min("dep").alias("min_dep"), F.max("arr").alias("max_arr"),
        F.count_if(F.col("arr") < F.col("dep")).alias("n_inversions"), F.count_if(wrap).alias("n_overnight"), F.count_if((F.col("arr") < F.col("dep")) & ~wrap).alias("n_wrap_errors"),
        F.count_if(F.col("back")).alias("n_backward"), F.count_if(F.col("from_stop") == F.col("to_stop")).alias("n_loops"), F.count_if(F.col("dep").isNull() | F.col("arr").isNull()).alias("n_null"),
    )


def require_sound(conn: DataFrame) -> None:
    """Refuse connections with missing times, loops, or arrivals that no midnight explains."""
    got = validation(conn).first()
    bad = {k: got[k] for k in ("n_wrap_errors", "n_backward", "n_loops", "n_null") if got[k]}
    if bad or not got.n_rows:
        raise ValueError(f"connections are not sound: {bad or 'there are none'}")


def graph_metrics(edges: DataFrame) -> DataFrame:
    """Nodes and edges of a graph, and the most edges out of a node."""
    degree = edges.groupBy("src").agg(F.count("*").alias("out"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).agg(F.countDistinct("node").alias("n_nodes"))
    return nodes.join(edges.agg(F.count("*").alias("n_edges")), F.lit(True)).join(degree.agg(F.max("out").alias("most_out")), F.lit(True))  # a row each


def shadow_unique(edges: DataFrame) -> DataFrame:
    """Whether each arrival has one ride into it."""
    per = edges.where("etype = 'RIDE'").groupBy("dst").agg(F.countDistinct("src").alias("n"))
    return per.agg(F.max("n").alias("most"), F.count_if(F.col("n") > 1).alias("n_shared"))


def disruption(events: DataFrame, good: int = 10) -> DataFrame:
    """Share of disrupted reports of each line and their severities, the commonest lines first."""
    each = events.groupBy("line", "severity").agg(F.count("*").alias("k"))
    listed = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("severity", "k"))), lambda s: F.concat_ws(":", s.severity, s.k)))
    per = each.groupBy("line").agg(F.sum("k").alias("n"), (F.sum(F.when(F.col("severity") < good, F.col("k")).otherwise(0)) / F.sum("k")).alias("disrupted"), listed.alias("severities"))
    return per.orderBy(F.desc("n"), "line").limit(30)


def line_status(raw: DataFrame) -> DataFrame:
    """``(id, severity, description)`` of the first status of each line in JSON texts."""
    kind = "array<struct<id: string, name: string, lineStatuses: array<struct<statusSeverity: int, statusSeverityDescription: string>>>>"
    lines = raw.select(F.explode(F.from_json("body", kind)).alias("l"))
    return lines.select("l.id", F.get("l.lineStatuses", F.lit(0)).alias("s")).select("id", F.col("s.statusSeverity").alias("severity"), F.col("s.statusSeverityDescription").alias("description"))


def siri_columns() -> tuple[Column, Column]:
    """Vehicles reported in a SIRI text ``body``, and minutes of delay."""
    return F.regexp_count("body", F.lit("<VehicleActivity>")), F.expr("transform(regexp_extract_all(body, '<Delay>PT([0-9]+)M', 1), x -> cast(x as int))")


def siri_delays(raw: DataFrame) -> DataFrame:
    """Vehicles reported and minutes of delay in SIRI texts."""
    vehicles, delays = siri_columns()
    return raw.select(vehicles.alias("vehicles"), delays.alias("delays"))
