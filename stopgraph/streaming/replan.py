"""A stream of edits against a standing set of queries: the answers that change, batch by batch.

Each micro-batch is logged under its number, the queries that its edits can touch are answered
again on the edited timetable, and those whose arrival is another one now are written under the
batch's number.  Only earlier batches are read for a batch, and its own files are replaced, so
one that runs again after a failure leaves the same log and the same changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators import arrivals as A
from ..operators import edits as E
from ..sources.store import discard, written
from . import edit_stream as S

#: Number of the answers before any batch.
FIRST = -1
CHANGES = "batch int, q_id int, src int, dst int, t_dep int, old_ea int, ea int"


def _log(spark: SparkSession, folder: str, below: int) -> DataFrame | None:
    """The edits of batches before ``below``; None where there are none."""
    rows = spark.read.schema(f"{S.SCHEMA}, batch int").option("basePath", f"{folder}/log").parquet(f"{folder}/log") if _there(spark, f"{folder}/log") else None
    if rows is None:
        return None
    rows = rows.where(F.col("batch") < below)
    return None if rows.isEmpty() else S.first_logged(rows)


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """``(batch, q_id, src, dst, t_dep, old_ea, ea)``: answers that became others, by batch."""
    return _written(spark, folder).where(F.col("batch") > FIRST)


def _written(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(CHANGES).option("basePath", f"{folder}/changes").parquet(f"{folder}/changes")
    return rows.select("batch", "q_id", "src", "dst", "t_dep", "old_ea", "ea")


def answers(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame:
    """``(q_id, src, dst, t_dep, ea)``: each query's answer after all batches, or those before ``below``."""
    rows = _written(spark, folder)
    rows = rows if below is None else rows.where(F.col("batch") < below)
    last = F.max_by(F.struct("src", "dst", "t_dep", "ea"), "batch").alias("a")
    return rows.groupBy("q_id").agg(last).select("q_id", "a.*")


def start(conn: DataFrame, walks: DataFrame, od: DataFrame, folder: str, held=None) -> None:
    """Write the answers of the timetable as it is, unless they are there."""
    if _there(conn.sparkSession, f"{folder}/changes/batch={FIRST}/_SUCCESS"):
        return
    first = A.answer(conn, walks, od, held=held).select("q_id", "src", "dst", "t_dep", F.lit(None).cast("int").alias("old_ea"), "ea")
    first.write.mode("overwrite").parquet(f"{folder}/changes/batch={FIRST}")


def touched(standing: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """Standing ``answers`` that connections going or coming can change.

    A journey boards nothing before its start, and nothing that leaves at or after its arrival,
    so an answer stands unless one of them leaves in between.  The minutes at which they leave
    are a row each; for every start the next one is looked up.
    """
    minutes = gone.select("dep").union(come.select("dep")).distinct().select(F.col("dep").alias("m"), F.lit(1).alias("kind"))
    starts = standing.select(F.col("t_dep").alias("m")).distinct().select("m", F.lit(0).alias("kind"))
    # a row a minute of the day and kind
    order = Window.orderBy("m", "kind").rowsBetween(0, Window.unboundedFollowing)
    following = starts.union(minutes).withColumn("next", F.first(F.when(F.col("kind") == 1, F.col("m")), ignorenulls=True).over(order))
    following = following.where("kind = 0 and next is not null").select(F.col("m").alias("t_dep"), "next")
    return standing.join(following, "t_dep").where("ea is null or next < ea").select("q_id", "src", "dst", "t_dep", "ea")


def answer_batch(conn: DataFrame, walks: DataFrame, folder: str, number: int, held=None) -> None:
    """Write the answers that batch ``number`` of the log changes.

    Edits are laid over the timetable, which ``held``, of ``arrivals.ready``, serves to all batches.
    """
    spark = conn.sparkSession
    before, after = _log(spark, folder, number), _log(spark, folder, number + 1)
    target = f"{folder}/changes/batch={number}"
    standing = answers(spark, folder, number)
    if after is None:
        standing.where("false").select("q_id", "src", "dst", "t_dep", F.col("ea").alias("old_ea"), "ea").write.mode("overwrite").parquet(target)
        return
    gone, come = E.delta(conn, before, after)
    again = written(touched(standing, gone, come), "again")
    new = A.answer_edit_sets(conn, walks, again.select("q_id", "src", "dst", "t_dep"), after, 1, held)
    both = new.join(again.select("q_id", F.col("ea").alias("old_ea")), "q_id").where("not (ea <=> old_ea)")
    both.select("q_id", "src", "dst", "t_dep", "old_ea", "ea").write.mode("overwrite").parquet(target)
    discard(again)


def replan(edits: DataFrame, conn: DataFrame, walks: DataFrame, od: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Answer ``od`` anew as the stream ``edits`` comes; read :func:`changes` and :func:`answers`.

    ``conn`` and ``walks`` are written tables; ``folder`` lies where all executors see it.
    """
    held = A.ready(conn, walks)
    start(conn, walks, od, folder, held)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        answer_batch(conn, walks, folder, number, held)

    return edits.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
