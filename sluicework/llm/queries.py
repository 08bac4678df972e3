"""The thin queries over whole tables that fix parameters and result columns.

Each returns a row for every row of its table, or for what it finds in it; empty tables give no
rows. What nulls, empty texts, repeated rows and clashing column names give is said in the module of
the operator that the query applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_store, fertility, forced_bpe, license_scan, minmax_dedup, prefix_forest, quality_ranker, ss_packing, toxicity_mil, url_model
from .common import fresh_path, read_table
from .vocabulary import public_path

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and verdict; training leaves the held-out fold out."""
    return quality_ranker.train_and_score(read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "documents"))


def op2_winnowed_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license text found in any document: its coverage, span and matched words."""
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op3_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each hundredth vector, of all others."""
    return prefix_forest.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_content_addressed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document's ids into a chunk store, and reads all of it back against its digests."""
    path = fresh_path(spark, "ids")
    chunk_store.write_store(read_table(spark, sf_dir, "documents"), path, public_path(BYTE_BPE), end_id=2)
    return chunk_store.verify(spark, path)


def op5_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to, as digests."""
    return forced_bpe.digests(read_table(spark, sf_dir, "documents"), public_path(BYTE_BPE))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op6_url_ngram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    weights = url_model.train(url_model.labelled_table(spark))
    judged = url_model.judge(read_table(spark, sf_dir, "pages"), URL_RULES, weights)
    return judged.withColumn("block_score", F.round("block_score", 6))


def op7_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near duplicates: four words a shingle, similarity 0.8."""
    return minmax_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op8_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, measures and verdicts."""
    return fertility.counts_and_verdicts(read_table(spark, sf_dir, "documents"), public_path(PIECE_BPE), public_path(BYTE_BPE))


def op9_multiple_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and verdict; training leaves the held-out fold out."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity_mil.score(docs, toxicity_mil.train(read_table(spark, sf_dir, "labels"), docs))


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 ids."""
    return ss_packing.pack(read_table(spark, sf_dir, "documents"), public_path(BYTE_BPE))
