"""Token shards: framing, index, splits, training windows, and reads by document or span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import packed_bytes, unpacked
from .prefix import exclusive_sums, ranges_of

#: Bytes of a token id in a shard.
WIDTH = 2


def byte_documents(docs: DataFrame, slug: str) -> DataFrame:
    """(slug, doc_id, seq_len, data) with one id for each byte, and EOS. Null texts are an error."""
    text = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("null text in document "), F.col("doc_id")))).otherwise(F.col("text"))
    return docs.select(F.col(slug).alias("slug"), "doc_id", (F.octet_length("text") + 1).cast("bigint").alias("seq_len"), packed_bytes(text).alias("data"))


def with_index(tokens: DataFrame) -> DataFrame:
    """Adds doc_seq (from 0) and st (tokens of the slug before the document)."""
    return exclusive_sums(tokens, ["slug"], ["doc_id"], ranges_of(tokens, "doc_id"), {"doc_seq": F.lit(1), "st": F.col("seq_len")})


def index(tokens: DataFrame) -> DataFrame:
    """(slug, doc_seq, seq_len, ptr): what an index file holds; reads no token."""
    return with_index(tokens.drop("data")).select("slug", "doc_seq", "seq_len", (F.col("st") * WIDTH).alias("ptr"))


def totals(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("slug").agg(F.count("*").alias("n_docs"), F.sum("seq_len").alias("n_tokens"))


def split_bounds(sizes: DataFrame, seq_len: int, val_frac: float) -> DataFrame:
    """(slug, n_tokens, cut, n_train, n_val) of a table with n_tokens: train is [0, cut), a multiple of seq_len."""
    cut = F.expr(f"(n_tokens - cast(n_tokens * {val_frac!r}D as bigint)) div {seq_len} * {seq_len}")
    n = lambda tokens: F.greatest(F.lit(0).cast("bigint"), F.expr(f"({tokens} - 1) div {seq_len}"))
    return sizes.withColumn("cut", cut).withColumn("n_train", n("cut")).withColumn("n_val", n("(n_tokens - cut)"))


def windows(tokens: DataFrame, seq_len: int, split: str, val_frac: float) -> DataFrame:
    """(slug, k, x, y) as packed ids: window k holds tokens [kS, kS + S], y is x moved on by one.

    A document's tokens are cut into the windows they touch; no token gets a row of its own. A
    window's pieces are gathered by (slug, k), so no task holds more than windows need.
    """
    s = seq_len
    rows = with_index(tokens)
    bounds = split_bounds(totals(tokens.drop("data")), s, val_frac)
    start, count = ("0L", "n_train") if split == "train" else ("cut", "n_val")
    placed = rows.join(F.broadcast(bounds.select("slug", F.expr(start).cast("bigint").alias("base"), F.col(count).alias("n"))), "slug")  # a row for each source of the plan
    at = placed.withColumn("st", F.col("st") - F.col("base")).where("st + seq_len > 0")
    touched = at.withColumn("k", F.explode(F.expr(f"sequence(greatest((st - 1) div {s}, 0L), (st + seq_len - 1) div {s})"))).where("k < n")
    low = F.greatest(F.col("st"), F.col("k") * s)
    high = F.least(F.col("st") + F.col("seq_len"), F.col("k") * s + s + 1)
    piece = touched.where(high > low).select("slug", "k", F.struct(low.alias("at"), F.substring("data", ((low - F.col("st")) * WIDTH + 1).cast("int"), ((high - low) * WIDTH).cast("int")).alias("ids")).alias("piece"))
    whole = piece.groupBy("slug", "k").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    joined = whole.select("slug", "k", F.expr("aggregate(pieces, X'', (a, p) -> concat(a, p.ids))").alias("w"))
    return joined.select("slug", "k", F.substring("w", 1, s * WIDTH).alias("x"), F.substring("w", 1 + WIDTH, s * WIDTH).alias("y"))


def as_ids(windows_: DataFrame) -> DataFrame:
    """Windows with x and y as array<int>."""
    return windows_.withColumn("x", unpacked(F.col("x"))).withColumn("y", unpacked(F.col("y")))


def get_document(tokens: DataFrame, slug: str, doc_seq: int) -> DataFrame:
    """The packed ids of one document by its place."""
    return with_index(tokens.where(F.col("slug") == slug)).where(F.col("doc_seq") == doc_seq).select("slug", "doc_seq", "seq_len", "data")


def get_span(tokens: DataFrame, slug: str, start: int, length: int) -> DataFrame:
    """(slug, data): packed ids [start, start + length) across documents; past the end is an error."""
    rows = with_index(tokens.where(F.col("slug") == slug)).where((F.col("st") < start + length) & (F.col("st") + F.col("seq_len") > start))
    low, high = F.greatest(F.col("st"), F.lit(start)), F.least(F.col("st") + F.col("seq_len"), F.lit(start + length))
    pieces = rows.select("slug", F.struct("st", F.substring("data", ((low - F.col("st")) * WIDTH + 1).cast("int"), ((high - low) * WIDTH).cast("int")).alias("ids")).alias("p"))
    span = pieces.groupBy("slug").agg(F.array_sort(F.collect_list("p")).alias("p")).select("slug", F.expr("aggregate(p, X'', (a, q) -> concat(a, q.ids))").alias("data"))
    message = F.lit(f"span of {length} tokens from {start} ends after the shard")
    return span.select("slug", F.when(F.octet_length("data") == length * WIDTH, F.col("data")).otherwise(F.raise_error(message).cast("binary")).alias("data"))
