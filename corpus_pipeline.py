"""The corpus pipeline: documents through five stages, each written and read again.

Toxic documents go, one document of each near-duplicate group stays, long repeated strings
are cut out of the texts, sources are mixed to target weights, and what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopgraph.llm import bpe, minhash, mixing, substrings, toxicity
from stopgraph.llm.common import Scratch, read_table

#: Similarity of near duplicates in percent, and bytes of a repeated string.
PERCENT, LENGTH = 75, 200
#: Share of the tokens left that the mix is to have, epochs of a source at most, and the seed.
MIX = {"percent": 90, "max_epochs": 2, "seed": 17}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go; texts are scored whole."""
    model = toxicity.fit(spark, docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=docs.columns, name="__score")
    return scored.where(~toxicity.toxic(name="__score")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id.

    Texts of one id count each by itself; of rows with equal id and text the one of the least
    hash stays, whatever else they hold; rows without an id stay.
    """
    groups = minhash.near_duplicates(spark, docs, percent=PERCENT)
    own = [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))]
    gone = groups.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    kept = docs.withColumns({"__id": own[0], "__hash": own[1]}).join(gone, ["__id", "__hash"], "left_anti").select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not rest:
        return kept.distinct().select(*docs.columns)
    one = kept.groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("__rest"))
    return one.select("doc_id", "text", *[F.col("__rest")[c].alias(c) for c in rest]).select(*docs.columns)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that also stand elsewhere are cut; a document with nothing left goes."""
    cut = substrings.removed(spark, docs, length=LENGTH)
    return cut.withColumn("n_chars", F.length("text").cast("long")).where(F.octet_length("text") > 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by domain, language and source up to the weights' budgets."""
    return mixing.documents_mixed(spark, docs, **MIX).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, and of its decoded text."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("substrings", cut_repeated_strings),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the encoding; tests/llm/test_pipeline.py compares
#: each stage with brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder."""
    scratch, docs, before = Scratch(spark), read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.drop(*before)  # read for the last time
        before = [f"stage-{name}"]
    return docs
