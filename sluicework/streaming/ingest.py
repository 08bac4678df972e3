"""Incremental ingest of documents into shards, with a token budget carried across batches.

A file stream is read as files arrive. Each micro-batch is cut where its source's budget ends,
given the tokens of all earlier batches, and appended as Parquet under the batch's number; the
ledger (batch, slug, n_docs, n_tokens) is written last. A batch that is run again after a
failure overwrites its own folders, so nothing is counted or stored twice. Where the stream
stands is kept in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import token_budget_cut

LEDGER = "batch long, slug string, n_docs long, n_tokens long, open boolean"


def ingest(stream: DataFrame, frame: Callable[[DataFrame], DataFrame], folder: str, budget: int, wait: bool = True, say: Callable[[int, int], None] | None = None, every: int = 5000):
    """Starts the query; ``frame`` makes (slug, doc_id, seq_len, ...) of a batch of the stream.

    Rows of a source that has used up its budget are read but not kept; progress is one ledger row
    for each batch and source. ``say`` gets a batch's number and the documents kept so far, whenever
    another ``every`` of them are reached.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = ledger(spark, folder).where(F.col("batch") < number).groupBy("slug").agg(F.sum("n_tokens").alias("used"))
        # a row for each source; a join by slug would put a source's tokens into one task, and the cut with them
        rows = frame(batch).join(F.broadcast(before), "slug", "left").withColumn("used", F.coalesce("used", F.lit(0)))
        kept = token_budget_cut(rows.where(F.col("used") <= budget), ["slug"], F.lit(budget) - F.col("used")).drop("used", "before")
        kept.write.mode("overwrite").parquet(f"{folder}/tokens/batch={number}")
        done = spark.read.parquet(f"{folder}/tokens/batch={number}").groupBy("slug").agg(F.count("*").alias("n_docs"), F.sum("seq_len").alias("n_tokens"))
        done = done.join(before, "slug", "left").select(F.lit(number).cast("long").alias("batch"), "slug", "n_docs", "n_tokens", (F.col("n_tokens") + F.coalesce("used", F.lit(0)) <= budget).alias("open"))
        done.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/{number}")
        if say:
            kept_docs = F.coalesce(F.sum("n_docs"), F.lit(0))
            past, now = (ledger(spark, folder).where(F.col("batch") < k).agg(kept_docs).first()[0] for k in (number, number + 1))
            if now // every > past // every:
                say(number, now)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All ledger rows so far; empty before the first batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(f"{folder}/ledger")


def document_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = 64) -> DataFrame:
    """Parquet files of a folder as they arrive, oldest first.

    Documents are in order within a batch, and batches in order of arrival. ``files_per_batch`` None
    puts all files that are there into one batch, so that their order is that of the documents.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (stream if files_per_batch is None else stream.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)
