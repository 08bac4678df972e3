"""Clean, rank, deduplicate and pack ``documents``: the stages in order, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluicework.llm import minmax_dedup, quality_ranker, ss_packing, toxicity_mil
from sluicework.llm.common import fresh_path, read_table, written
from sluicework.llm.queries import BYTE_BPE
from sluicework.llm.vocabulary import public_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the multiple-instance model calls toxic."""
    model = toxicity_mil.train(read_table(spark, sf_dir, "labels"), docs)
    return toxicity_mil.keep(docs, model)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking puts above its cut."""
    ranker = quality_ranker.train(read_table(spark, sf_dir, "labels"), docs)
    return quality_ranker.keep(docs, ranker)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, similarity 0.8."""
    return minmax_dedup.keep_one(docs, shingle=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in padded sequences, as op10 returns them."""
    return ss_packing.pack(docs, public_path(BYTE_BPE))


STAGES = [("toxicity", toxicity), ("quality classifier", quality), ("near-dedup", near_duplicates), ("packing", packing)]

#: No stage before the last can be told in SQL: two are trained models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again as the next one's input.

    Filters keep all columns as they are, whatever they are called, and rows as often as they occur;
    documents of null or empty text go through like others. Rows without doc_id can't be near copies
    of any and stay. Without labels the filters reject nothing. An empty table gives no pieces.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name, fresh_path(spark, name.replace(" ", "-")))
    return docs
