"""Edits as a stream of files: appended to a log, however late, counted, applied as a view."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.minutes import hour_weights
from ..operators.edits import draw

SCHEMA = "edit_id long, ts timestamp, pos int, edit_type string, trip_id int, delta_min int, template_trip_id int, start_minute int"


def read(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of edits; of ``files`` files a batch where that is given.

    No edit is too late: order is that of ``pos``, and one that comes twice counts once in
    the log's view, so the stream needs neither state nor a watermark.
    """
    reader = spark.readStream.schema(SCHEMA)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def append_log(edits: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to the log under its number: a batch run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return edits.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches(spark: SparkSession, log: str) -> DataFrame:
    """Edits of each micro-batch in the log: their number, kinds and delay between first and last."""
    rows = spark.read.option("basePath", log).parquet(log)
    kinds = [F.count_if(F.col("edit_type") == k).alias(f"n_{k.lower()}") for k in ("DELAY", "CANCELLATION", "ADDITION", "RESTORE")]
    return rows.groupBy("batch").agg(F.count("*").alias("n_edits"), *kinds, F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def log_edits(spark: SparkSession, log: str) -> DataFrame:
    """The log as an edit set."""
    return first_logged(spark.read.option("basePath", log).parquet(log))


def first_logged(rows: DataFrame) -> DataFrame:
    """Logged rows as an edit set; of an edit logged in several batches the first counts."""
    one = F.min_by(F.struct("pos", "edit_type", "trip_id", "delta_min", "template_trip_id", "start_minute"), "batch").alias("e")
    return rows.groupBy("edit_id").agg(one).select(F.lit(0).alias("edit_set"), "e.*", F.lit(True).alias("active"))


def replay(trips: DataFrame, n: int, seed: int, mean_delay: float = 4.0, cancel_share: float = 0.10, add_share: float = 0.05) -> DataFrame:
    """A day's synthetic edits of ``trips(trip_no, trip)``, in order of time.

    Hours are drawn by their weights, kinds by their shares; delays are lognormal about
    ``mean_delay`` with a deviation of 0.7, cut to 1 to 30 minutes, and added trips start up
    to ten minutes later than their template.  All draws are hashes of the edit's number.
    """
    u = lambda tag: draw("edit_idx", F.lit(tag), seed=seed)
    rows = trips.sparkSession.range(n).select(F.col("id").cast("int").alias("edit_idx"))
    hour, below = F.lit(0), 0.0
    for k, weight in enumerate(hour_weights()):
        hour, below = (F.when(u("hour") >= below, k).otherwise(hour) if k else hour), below + weight
    normal = F.sqrt(-2 * F.ln(u("normal") + F.lit(1e-12))) * F.cos(2 * math.pi * u("angle"))
    late = F.floor(F.least(F.lit(30.0), F.greatest(F.lit(1.0), F.exp(F.lit(math.log(max(1.0, mean_delay))) + F.lit(0.7) * normal))))
    kind = F.when(u("kind") < 1 - cancel_share - add_share, "delay").when(u("kind") < 1 - add_share, "cancel").otherwise("add")
    out = rows.withColumn("t_offset_sec", (hour * 3600 + F.floor(u("second") * 3600)).cast("int")).withColumn("op_type", kind)
    minutes = F.when(F.col("op_type") == "delay", late).when(F.col("op_type") == "add", F.floor(u("add") * 10)).otherwise(0)
    out = out.withColumn("delay_min", minutes.cast("int"))
    total = trips.agg(F.count("*").alias("total"))
    out = out.join(F.broadcast(total), F.lit(True)).withColumn("trip_no", F.floor(u("trip") * F.col("total")).cast("int"))  # one row
    return out.join(trips, "trip_no").select("edit_idx", "t_offset_sec", "op_type", F.col("trip").alias("trip_id"), "delay_min").orderBy("t_offset_sec", "edit_idx")
