"""Corpus building: byte shares, deterministic interleaving, and cuts by bytes or tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_line_bytes, nonempty
from .prefix import exclusive_sums, ranges_of


def project_text(df: DataFrame, text_field: str, *keep: str) -> DataFrame:
    """Only the text, renamed, and the columns named."""
    return df.select(*keep, F.col(text_field).alias("text"))


def avg_doc_bytes(docs: DataFrame, group: str, order: str = "doc_id", sample_size: int = 2000) -> DataFrame:
    """(group, avg_bytes): mean UTF-8 length of the non-empty ones of each group's first rows; 0.0 if none.

    Only a row's length is ranked, and ranking keeps ``sample_size`` rows of a group in each task.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    sized = docs.select(group, order, F.when(nonempty(F.col("text")), F.octet_length("text")).alias("b"))
    first = sized.withColumn("rn", rank).where(F.col("rn") <= sample_size)
    return first.groupBy(group).agg(F.coalesce(F.sum("b") / F.count("b"), F.lit(0.0)).alias("avg_bytes"))


def byte_weighted(averages: DataFrame, targets: DataFrame, group: str) -> DataFrame:
    """(group, avg_bytes, target, p): draw shares that give the target byte shares. A row for each source."""
    raw = F.when(F.col("avg_bytes") > 0, F.col("target") / F.col("avg_bytes")).otherwise(0.0)
    both = targets.join(averages, group).withColumn("raw", raw)
    total = F.sum("raw").over(Window.partitionBy())
    return both.select(group, "avg_bytes", "target", F.when(total > 0, F.col("raw") / total).otherwise(F.col("raw")).alias("p"))


def byte_cut(docs: DataFrame, target: int, order: list[str], bucket: Column) -> DataFrame:
    """Rows written before ``target`` bytes are reached: those with fewer bytes before them."""
    lines = docs.withColumn("line_bytes", json_line_bytes(F.col("text")))
    return exclusive_sums(lines, [], order, bucket, {"before": F.col("line_bytes")}).where(F.col("before") < target)


def interleave(docs: DataFrame, shares: DataFrame, group: str, order: str = "doc_id") -> DataFrame:
    """Documents of all sources mixed by ``shares`` (group, ord, p): columns t, ord, j for the order.

    Document j of a source stands at (j + 0.5) / p. Sources that end early start again until each
    has ended once. Sources of share 0 are left out.
    """
    shares = shares.where("p > 0")
    rows = exclusive_sums(docs, [group], [order], ranges_of(docs, order), {"own": F.lit(1)})
    n = rows.groupBy(group).agg(F.count("*").alias("n"))
    ends = n.join(shares, group).withColumn("end", F.max(F.col("n") / F.col("p")).over(Window.partitionBy()))
    spans = ends.select(group, "ord", "p", "n", F.floor(F.col("p") * F.col("end") + 0.5).cast("bigint").alias("m"))
    mixed = rows.join(F.broadcast(spans), group).where("own < m")  # a row for each source
    again = mixed.withColumn("pass", F.explode(F.expr("sequence(0L, (m - own - 1) div n)")))
    j = F.col("pass") * F.col("n") + F.col("own")
    return again.withColumn("j", j).withColumn("t", (j + 0.5) / F.col("p")).drop("own", "n", "m", "pass", "p")


def tokenizer_corpus(docs: DataFrame, shares: DataFrame, group: str, target: int, width: float = 4096.0) -> DataFrame:
    """Interleaved non-empty documents up to a number of bytes, in the order t, ord, j."""
    # lines are measured first, so that texts are only carried along for those who ask for them
    lines = docs.withColumn("line_bytes", json_line_bytes(F.col("text"))).withColumn("_written", nonempty(F.col("text")))
    mixed = interleave(lines, shares, group).where("_written").drop("_written")
    return exclusive_sums(mixed, [], ["t", "ord", "j"], F.floor(F.col("t") / width), {"before": F.col("line_bytes")}).where(F.col("before") < target)


def token_budget_cut(tokens: DataFrame, group: list[str], budget: Column, order: str = "doc_id") -> DataFrame:
    """Rows kept while the tokens before them don't exceed the budget; the row that crosses it stays."""
    return exclusive_sums(tokens, group, [order], ranges_of(tokens, order), {"before": F.col("seq_len")}).where(F.col("before") <= budget)


def skip_rows(docs: DataFrame, n: int, order: str = "doc_id") -> DataFrame:
    """The rows after the first ``n`` in order: where a reader that has seen ``n`` rows goes on."""
    return exclusive_sums(docs, [], [order], ranges_of(docs, order), {"seen": F.lit(1)}).where(F.col("seen") >= n).drop("seen")


def first_rows(docs: DataFrame, group: str, n: int, order: str = "doc_id") -> DataFrame:
    """Each group's first ``n`` rows in order."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return docs.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
