"""Resamples by counting against resamples by joining each draw."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stopgraph.functions.draws import draws
from stopgraph.operators import reports


def test_draws_are_those_of_the_hash():
    for r, first, end in ((1, 0, 1200), (1000, 99_990, 100_020)):
        want = [int(hashlib.md5(f"9:{r}:{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(first, end)]
        assert draws(9, r, first, end).tolist() == want


@pytest.mark.parametrize("value", ["cast(id * 7919 % 3001 as double) / 7", "cast(id % 3 as double)", "1.5D"])
def test_counting_equals_joining(spark, monkeypatch, value):
    """Before, every draw was a row of a shuffle; odd and even numbers of rows, ties, pieces cut anywhere."""
    monkeypatch.setattr(reports, "HASHED", 700)
    monkeypatch.setattr(reports, "CODED", 512)
    for n in (3001, 100):
        rows = spark.range(n).selectExpr("id as pos", f"{value} as value")
        got = {r.r: r.m for r in reports._medians(rows, "value", 60, 5).collect()}
        assert got == {r.r: r.m for r in reports._medians_by_join(rows, "value", 60, 5).collect()}


def test_missing_values_are_joined(spark):
    rows = spark.range(40).select(F.col("id").alias("pos"), F.when(F.col("id") % 4 > 0, F.col("id").cast("double")).alias("value"))
    assert reports._medians(rows, "value", 10, 5) is None and reports.bootstrap(rows, "value", 10, 5).first().low is not None
