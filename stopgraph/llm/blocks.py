"""Query blocks against data blocks: the shared plan of the two vector operators.

Data rows lie in cells (index lists or annuli); each query row names the cells that it has
to see.  A cell of many rows is cut into blocks by a hash, and so are a cell's queries; a
task call gets one block of each.  So no call holds more than about two blocks, whatever a
cell holds, and rows are copied only as often as the other side has blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group


def block_join(data: DataFrame, queries: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.RecordBatch | None], schema: str, block: int, key: str = "id") -> DataFrame:
    """``fn(data rows, query rows)`` for each pair of blocks of a cell.

    Both inputs have the same columns, ``cell int`` and the row's number ``key`` among them.  The counts
    of rows by cell are the only thing that is broadcast: one row for each cell of the
    index, whose number is fixed when the index is made.
    """
    columns = [c for c in data.columns if c != "cell"]
    sizes = data.groupBy("cell").agg(F.count("*").alias("n_data")).join(queries.groupBy("cell").agg(F.count("*").alias("n_query")), "cell")
    sizes = F.broadcast(sizes.select("cell", F.ceil(F.col("n_data") / block).cast("int").alias("nd"), F.ceil(F.col("n_query") / block).cast("int").alias("nq")))
    d = data.join(sizes, "cell").withColumn("i", F.pmod(F.xxhash64(key), F.col("nd")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    q = queries.join(sizes, "cell").withColumn("j", F.pmod(F.xxhash64(key), F.col("nq")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nd") - 1)))
    both = d.select("cell", "i", "j", F.lit(0).alias("side"), *columns).unionByName(q.select("cell", "i", "j", F.lit(1).alias("side"), *columns))

    def run(table: pa.Table):
        side = table.column("side").to_numpy()
        n = int((side == 0).sum())
        if n == 0 or n == len(side):
            return None
        return fn(table.slice(0, n), table.slice(n))

    return by_group(both, ["cell", "i", "j"], run, schema, order=["side", key])
