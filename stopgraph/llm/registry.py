"""The subpackage's queries, each over its whole table, and the SQL of those that have it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, licenses, minhash, mixing, pq, quality, resampling, rules, substrings, topk, toxicity, warc
from .common import held_out, read_table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs)


#: Share of the tokens that the mix is to have, epochs of a source at most, and the seed.
MIX = {"percent": 60, "max_epochs": 3, "seed": 17}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.documents_mixed(spark, docs, **MIX)
    path = {k: F.coalesce(c, F.lit("")) for k, c in mixing.document_path().items()}
    return mixed.select("doc_id", *[c.alias(k) for k, c in path.items()], "mix_epoch", "mix_tokens")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(spark, read_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, read_table(spark, sf_dir, "documents"), percent=75).drop("text_hash")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(spark, read_table(spark, sf_dir, "documents"), length=200)


def _scored(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(spark, docs, read_table(spark, sf_dir, "labels"))
    return _scored(toxicity.score(docs, model), 0.5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(spark, docs, read_table(spark, sf_dir, "labels"))
    return _scored(quality.score(docs, model), 0.3)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, read_table(spark, sf_dir, "pages"))
    return records.select(
        F.expr("try_cast(record_id as bigint)").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
    )


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    drawn = resampling.resample(spark, docs, target, longest=1, buckets=10000, percent=10, min_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark, read_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64, seed=1)


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assess(spark, read_table(spark, sf_dir, "documents")).drop("char_divergence", "word_divergence")


QUERIES = {"op1_topk": op1_topk, "op2_mixing": op2_mixing, "op3_bpe": op3_bpe, "op4_pq": op4_pq, "op5_minhash": op5_minhash, "op6_substrings": op6_substrings, "op7_toxicity": op7_toxicity, "op8_quality": op8_quality, "op9_warc": op9_warc, "op10_licenses": op10_licenses, "op11_resampling": op11_resampling, "op12_centroids": op12_centroids, "op13_rules": op13_rules}

ORACLES: dict[str, str] = {"op2_mixing": mixing.document_sql(**MIX), "op12_centroids": centroids.sql(), "op13_rules": rules.sql()}
