"""Derived tables kept beside fingerprints of what they were derived from.

A cached table is a folder with the table as Parquet and one JSON line that tells its kind,
its parameters and the fingerprints of its sources.  Reading it back compares all of them
with the sources at hand; anything else than equality is an error, never a silent rebuild.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


class Stale(Exception):
    """A cached table that does not belong to the sources or parameters at hand."""


def fingerprint(df: DataFrame) -> str:
    """Row count, column names and two sums of row hashes: the same in any order of rows."""
    hashes = [F.sum(F.xxhash64(F.lit(k), *df.columns).cast("decimal(38,0)")).alias(f"h{k}") for k in range(2)]
    got = df.agg(F.count("*").alias("n"), *hashes).first()
    return ":".join([",".join(f"{n} {t}" for n, t in df.dtypes), str(got.n), str(got.h0 or 0), str(got.h1 or 0)])


def _sidecar(kind: str, sources: dict[str, DataFrame], params: dict) -> dict:
    return {"version": VERSION, "kind": kind, "params": params, "sources": {k: fingerprint(v) for k, v in sorted(sources.items())}}


def save(df: DataFrame, path: str, kind: str, sources: dict[str, DataFrame], params: dict) -> None:
    """Write ``df`` and what it was derived from."""
    df.write.mode("overwrite").parquet(f"{path}/table")
    line = json.dumps(_sidecar(kind, sources, params), sort_keys=True)
    df.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")


def load(spark: SparkSession, path: str, kind: str, sources: dict[str, DataFrame], params: dict) -> DataFrame:
    """The table at ``path``, or :class:`Stale` with all that differs."""
    kept, now = json.loads(spark.read.text(f"{path}/sidecar").first()[0]), _sidecar(kind, sources, params)
    differ = [k for k in ("version", "kind", "params") if kept[k] != now[k]]
    differ += [f"source {k}" for k in sorted(kept["sources"].keys() | now["sources"].keys()) if kept["sources"].get(k) != now["sources"].get(k)]
    if differ:
        raise Stale(f"{path}: {', '.join(differ)} differ")
    return spark.read.parquet(f"{path}/table")


def cached(build, spark: SparkSession, path: str, kind: str, sources: dict[str, DataFrame], params: dict, refresh: bool = False) -> DataFrame:
    """The table at ``path``; where there is none, ``build()`` is written there first.

    A stale table raises :class:`Stale`, as :func:`load` does; with ``refresh`` it is built anew.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/sidecar")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        try:
            return load(spark, path, kind, sources, params)
        except Stale:
            if not refresh:
                raise
    save(build(), path, kind, sources, params)
    return load(spark, path, kind, sources, params)
