"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import (bpe, exact_dedup, hilbert_packing, licenses, merkle, minhash_dedup, mixing, pii, sharding, spelling,
               token_counts, topk_search, toxicity)
from .oracles import ORACLES as _SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    if fn.__name__ in _SQL:
        ORACLES[fn.__name__] = _SQL[fn.__name__]
    return fn


@_query
def op1_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shards = sharding.shard_documents(docs)
    # a document above the limit is a shard of its own: name it by its id
    page = F.when(F.col("depth") < 0, F.col("doc_id")).otherwise(F.col("page"))
    return shards.withColumn("page", page).drop("row_id")


@_query
def op4_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_counts(docs).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op6_two_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@_query
def op7_quotient_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("row_key")


@_query
def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_packing.pack_documents(table(spark, sf_dir, "documents"))


@_query
def op2_norm_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


@_query
def op3_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.find_private(table(spark, sf_dir, "documents")))


@_query
def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@_query
def op9_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


@_query
def op11_matrix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@_query
def op12_trie_pair_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@_query
def op13_path_copy_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.verify_documents(table(spark, sf_dir, "documents"))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")
