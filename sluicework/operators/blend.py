"""Blending sources window by window: sizes, quotas, order, ranks, batches, resumption.

The sources of a mix are a small table (ds, slug, weight, n_samples); the schedule has a row for
each window and is ordered without gathering it in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import exclusive_sums


def normalized(sources: DataFrame) -> DataFrame:
    """Weights divided by their sum."""
    return sources.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def missing(sources: DataFrame, shards: DataFrame) -> DataFrame:
    """Slugs of a mix for which there is no shard."""
    return sources.select("slug").join(shards.select("slug"), "slug", "left_anti").distinct()


def blend_size(sources: DataFrame) -> DataFrame:
    """(size): most windows that no source with a weight runs out in."""
    return normalized(sources).where("weight > 0").agg(F.min(F.col("n_samples") / F.col("weight")).cast("bigint").alias("size"))


def quotas(sources: DataFrame, size: Column) -> DataFrame:
    """(ds, slug, weight, n_samples, n): windows of each source by largest remainder, ties to the first source."""
    raw = normalized(sources).withColumn("raw", F.col("weight") * size).withColumn("floor", F.floor("raw").cast("bigint"))
    every = Window.partitionBy()
    ranked = raw.withColumn("left", size - F.sum("floor").over(every)).withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("raw") - F.col("floor")), "ds")))
    return ranked.select("ds", "slug", "weight", "n_samples", (F.col("floor") + (F.col("rn") <= F.col("left")).cast("bigint")).alias("n"))


def checked(quota: DataFrame) -> DataFrame:
    """Fails where a source has fewer windows than its quota."""
    text = F.format_string("source '%s' needs %d windows and has %d: reduce the size, raise its budget or change the weights", "slug", "n", "n_samples")
    return quota.withColumn("n", F.when(F.col("n") > F.col("n_samples"), F.raise_error(text).cast("bigint")).otherwise(F.col("n")))


def schedule(quota: DataFrame, width: float = 65536.0, chunk: int = 1 << 16) -> DataFrame:
    """(pos, ds, sample): window j of source i stands at (j + 0.5) / weight; ties to the first source.

    A source's windows are made in chunks, each by a task of its own: no row holds more than
    ``chunk`` numbers, or a number for each chunk.
    """
    chunks = quota.where("n > 0").select("ds", "weight", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {chunk})")).alias("chunk")).repartition("ds", "chunk")
    own = F.expr(f"sequence(chunk * {chunk}, least(n, (chunk + 1) * {chunk}) - 1)")
    rows = chunks.select("ds", "weight", F.explode(own).alias("sample")).withColumn("t", (F.col("sample") + 0.5) / F.col("weight"))
    placed = exclusive_sums(rows, [], ["t", "ds", "sample"], F.floor(F.col("t") / width), {"pos": F.lit(1)})
    return placed.select("pos", "ds", "sample")


def rank_shard(blend: DataFrame, size: Column, world: int, rank: int | None = None) -> DataFrame:
    """(rank, idx, ds, sample) of one rank or all: every world-th window; the remainder is dropped."""
    rows = blend.where(F.col("pos") < F.floor(size / world) * world)
    out = rows.select((F.col("pos") % world).alias("rank"), F.floor(F.col("pos") / world).alias("idx"), "ds", "sample")
    return out if rank is None else out.where(F.col("rank") == rank)


def batches(blend: DataFrame, windows: DataFrame, batch_size: int) -> DataFrame:
    """(batch, item, ds, sample, x, y): windows (ds, k, x, y) in blend order, the last batch may be short."""
    rows = blend.withColumn("batch", F.floor(F.col("pos") / batch_size)).withColumn("item", F.col("pos") % batch_size)
    return rows.join(windows.withColumnRenamed("k", "sample"), ["ds", "sample"]).select("batch", "item", "ds", "sample", "x", "y")


def cache_key(sources: DataFrame, size: Column, seq_len: int, split: str) -> DataFrame:
    """(key): 12 hex digits over slugs, weights, size and each source's windows. One row from a small table."""
    row = normalized(sources).agg(F.array_sort(F.collect_list(F.struct("ds", "slug", F.format_string("%.6f", "weight").alias("w"), F.format_string(f"{seq_len}:{split}:%d", "n_samples").alias("s")))).alias("a"))
    part = lambda f: F.array_join(F.col(f"a.{f}"), ",")
    return row.select(F.substring(F.md5(F.concat_ws("|", part("slug"), part("w"), size.cast("string"), part("s"))), 1, 12).alias("key"))


def cached(sources: DataFrame, size: int, seq_len: int, split: str, folder: str) -> DataFrame:
    """The schedule from ``folder``, where one with these sources, sizes and weights is kept; else it is made and kept.

    A schedule that was not written to its end has no success mark, and is made again.
    """
    spark = sources.sparkSession
    path = f"{folder.rstrip('/')}/blend-{cache_key(sources, F.lit(size), seq_len, split).first().key}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        schedule(checked(quotas(sources, F.lit(size)))).write.mode("overwrite").parquet(path)
    return spark.read.schema("pos long, ds int, sample long").parquet(path)
