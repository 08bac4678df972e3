"""Model arithmetic as array expressions, for checking and small inference; no training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def rmsnorm(x: Column, gamma: Column | None = None, eps: float = 1e-6) -> Column:
    rms = F.sqrt(_sum(F.transform(x, lambda v: v * v)) / F.size(x) + eps)
    scaled = F.flatten(F.transform(F.array(rms), lambda r: F.transform(x, lambda v: v / r)))  # rms once for all
    return scaled if gamma is None else F.zip_with(scaled, gamma, lambda v, g: v * g)


def silu(v: Column) -> Column:
    return v / (1.0 + F.exp(-v))


def linear(x: Column, weights: Column) -> Column:
    """x times the transposed matrix, an array of rows; no bias."""
    return F.transform(weights, lambda row: dot(x, row))


def swiglu(x: Column, gate: Column, up: Column, down: Column) -> Column:
    return linear(F.zip_with(linear(x, up), F.transform(linear(x, gate), silu), lambda u, g: u * g), down)


def rope_table(spark: SparkSession, max_seq: int, head_dim: int, theta: float = 10000.0) -> DataFrame:
    """(pos, i, cos, sin): the second half of the dimensions repeats the first."""
    i = F.col("c.id") % (head_dim // 2)
    angle = F.col("p.id") / F.pow(F.lit(theta), 2.0 * i / head_dim)
    grid = spark.range(max_seq).alias("p").join(spark.range(head_dim).alias("c"), F.lit(True))  # two small ranges: the table itself
    return grid.select(F.col("p.id").alias("pos"), F.col("c.id").cast("int").alias("i"), F.cos(angle).alias("cos"), F.sin(angle).alias("sin"))


def rope(x: Column, pos: Column, head_dim: int, theta: float = 10000.0) -> Column:
    """Rotates the two halves of a head's vector by its position."""
    h = head_dim // 2
    ks = F.sequence(F.lit(0), F.lit(head_dim - 1))

    def at(k: Column) -> Column:
        angle = pos / F.pow(F.lit(theta), 2.0 * (k % h) / head_dim)
        other = F.when(k < h, -F.element_at(x, (k + h + 1).cast("int"))).otherwise(F.element_at(x, (k - h + 1).cast("int")))
        return F.element_at(x, (k + 1).cast("int")) * F.cos(angle) + other * F.sin(angle)

    return F.transform(ks, at)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    exps = F.flatten(F.transform(F.array(top), lambda m: F.transform(scores, lambda s: F.exp(s - m))))
    return F.flatten(F.transform(F.array(_sum(exps)), lambda t: F.transform(exps, lambda e: e / t)))


def cross_entropy(logits: Column, y: Column) -> Column:
    top = F.array_max(logits)
    return F.ln(_sum(F.transform(logits, lambda v: F.exp(v - top)))) + top - F.element_at(logits, y + 1)


def causal_attention(rows: DataFrame, scale: float) -> DataFrame:
    """(seq, head, pos, out) of rows (seq, head, pos, q, k, v): softmax over positions up to the own.

    Keys and values of one sequence and head are gathered for each of its positions, as attention
    needs them; sequences are bounded by the model's longest.
    """
    keys = rows.groupBy("seq", "head").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "v"))).alias("kv"))
    past = rows.select("seq", "head", "pos", "q").join(keys, ["seq", "head"]).withColumn("kv", F.filter("kv", lambda e: e["pos"] <= F.col("pos")))
    weights = past.withColumn("w", softmax(F.transform("kv", lambda e: dot(F.col("q"), e["k"]) * scale)))
    mixed = F.aggregate(F.zip_with("w", "kv", lambda w, e: F.transform(e["v"], lambda v: v * w)), F.transform(F.col("q"), lambda _: F.lit(0.0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return weights.select("seq", "head", "pos", mixed.alias("out"))


def grouped_heads(rows: DataFrame, n_heads: int, n_kv_heads: int) -> DataFrame:
    """Query rows (seq, head, pos, q) with the keys and values (seq, kv_head, pos, k, v) of their group."""
    raise_ = n_heads % n_kv_heads
    if raise_:
        raise ValueError("the heads must be a multiple of the key-value heads")
    return rows.withColumn("kv_head", F.floor(F.col("head") / (n_heads // n_kv_heads)).cast("int"))


def grouped_attention(queries: DataFrame, keys: DataFrame, n_heads: int, n_kv_heads: int, scale: float) -> DataFrame:
    """(seq, head, pos, out) of queries (seq, head, pos, q) over keys (seq, kv_head, pos, k, v).

    Each key-value head serves ``n_heads / n_kv_heads`` query heads; a position sees those up to its own.
    """
    both = grouped_heads(queries, n_heads, n_kv_heads).join(keys, ["seq", "kv_head", "pos"])
    return causal_attention(both, scale)


def block(x: DataFrame, weights: DataFrame, n_heads: int, n_kv_heads: int, head_dim: int, eps: float = 1e-6, theta: float = 10000.0) -> DataFrame:
    """(seq, pos, x): one transformer block over rows (seq, pos, x).

    weights: one row with norm1, norm2 (arrays) and wq, wk, wv, wo, gate, up, down (arrays of rows). x +
    attention of its norm, rotated by position, then + the gated feed-forward of that one's norm.
    """
    rows = x.join(F.broadcast(weights))  # one row of weights, as large as the model's shapes say
    normed = rows.withColumn("h", rmsnorm(F.col("x"), F.col("norm1"), eps))
    part = lambda c, k: F.slice(c, k * head_dim + 1, head_dim)
    heads = lambda c, n: F.array(*(part(c, k) for k in range(n)))
    q = normed.select("seq", "pos", F.posexplode(heads(linear(F.col("h"), F.col("wq")), n_heads)).alias("head", "q"))
    q = q.withColumn("q", rope(F.col("q"), F.col("pos"), head_dim, theta))
    kv = normed.select("seq", "pos", heads(linear(F.col("h"), F.col("wk")), n_kv_heads).alias("ks"), heads(linear(F.col("h"), F.col("wv")), n_kv_heads).alias("vs"))
    kv = kv.select("seq", "pos", F.posexplode(F.arrays_zip("ks", "vs")).alias("kv_head", "e")).select("seq", "pos", "kv_head", rope(F.col("e.ks"), F.col("pos"), head_dim, theta).alias("k"), F.col("e.vs").alias("v"))
    mixed = grouped_attention(q, kv, n_heads, n_kv_heads, head_dim**-0.5).groupBy("seq", "pos").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("head", "out"))), lambda e: e["out"])).alias("a"))
    after = rows.join(mixed, ["seq", "pos"]).withColumn("x", F.zip_with("x", linear(F.col("a"), F.col("wo")), lambda a, b: a + b))
    fed = after.withColumn("h", rmsnorm(F.col("x"), F.col("norm2"), eps)).withColumn("f", swiglu(F.col("h"), F.col("gate"), F.col("up"), F.col("down")))
    return fed.select("seq", "pos", F.zip_with("x", "f", lambda a, b: a + b).alias("x"))


def embedded(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with ``id`` and the vector that the table (id, vector) has for it."""
    return tokens.join(table, "id")
