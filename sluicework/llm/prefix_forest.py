"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives a vector a string of ``BITS`` bits: on which side of a plane it lies, plane by
plane; a tree is the sorted array of its strings. A query descends in every tree to the longest
prefix it shares with any string there, found by binary search, then all trees ascend together,
one bit at a time, until the ranges under the prefixes hold ``SHARE`` of the vectors. These
candidates, all of them, are then measured exactly.

The planes' offsets are medians over a bounded sample (``SAMPLE`` vectors, chosen by a hash of the
id); every vector is indexed. Tasks build forests over shards of up to ``SHARD`` of their own rows
and never shuffle vectors; only each task's nearest few per query are. Queries go to the tasks in
blocks of at most ``BLOCK``, cut by ranges of their ids. On vectors without any structure (the test tables' are uniform on
the sphere) nearness hardly shows in few bits, so a recall of 0.9 takes a large share.

Edge cases: vectors that are null, zero, of another length than most, or that hold nulls or
non-finite numbers take no part; rows repeated in the table are candidates each, a repeated query
is one; with fewer candidates than asked for all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS, TREES, SAMPLE, SHARD, BLOCK = 24, 32, 4096, 16_384, 32_768
#: Share of a shard that the candidates must reach, and the least number of them.
SHARE, LEAST = 0.40, 256


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = F.expr("vec_id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(v, x -> x <> 0)")
    return v.where(ok)


def fit(vectors: DataFrame, trees: int, bits: int, sample: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Directions (dim, trees * bits), offsets and the length most vectors have; None without vectors."""
    lengths = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return None
    d = lengths[0].d
    rows = vectors.where(F.size("v") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    x = np.asarray([r.v for r in rows])
    rng = np.random.default_rng(11)
    planes = []
    while len(planes) < trees:
        # directions of one tree are orthogonal as far as the dimension allows
        q = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-bits // d))]
        planes.append(np.hstack(q)[:, :bits])
    p = np.hstack(planes)
    return p, np.median(x @ p, axis=0), d


def codes_of(x: np.ndarray, planes: np.ndarray, offsets: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """(trees, n) strings of bits as numbers, first plane highest."""
    side = (x @ planes > offsets).reshape(len(x), trees, bits)
    return (side @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).T.astype(np.int64)


class Forest:
    """Sorted arrays over one shard of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, planes: np.ndarray, offsets: np.ndarray, trees: int, bits: int):
        self.ids, self.x, self.bits = ids, x, bits
        codes = codes_of(x, planes, offsets, trees, bits)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def ranges(self, codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query the part of the array that shares the first ``level`` bits."""
        low = (codes >> (self.bits - level)) << (self.bits - level)
        high = low + (1 << (self.bits - level))
        return tuple(np.stack([np.searchsorted(s, c) for s, c in zip(self.sorted, bound)]) for bound in (low, high))

    def candidates(self, codes: np.ndarray, share: float, least: int) -> Iterator[np.ndarray]:
        """Each query's candidates, as places in the shard."""
        n = len(self.ids)
        target = min(n, max(least, int(np.ceil(share * n))))
        levels = [self.ranges(codes, level) for level in range(self.bits + 1)]
        totals = np.stack([(hi - lo).sum(axis=0) for lo, hi in levels])  # of all trees, by level
        for q in range(codes.shape[1]):
            level = int(np.flatnonzero(totals[:, q] >= target).max(initial=0))
            while True:
                lo, hi = levels[level]
                inside = np.zeros(n, bool)
                for t in range(len(self.order)):
                    inside[self.order[t, lo[t, q] : hi[t, q]]] = True
                if level == 0 or inside.sum() >= target:
                    break
                level -= 1
            yield np.flatnonzero(inside)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, codes: np.ndarray, k: int, share: float, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the k nearest of its candidates: ids and distances, ties by smaller id."""
        out = []
        for q, found in enumerate(self.candidates(codes, share, least)):
            found = found[self.ids[found] != query_ids[q]]
            diff = self.x[found] - queries[q]
            dist = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            out.append(smallest(self.ids[found], dist, k))
        return out


def smallest(ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(dist) > k:
        near = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
        ids, dist = ids[near], dist[near]
    best = np.lexsort((ids, dist))[:k]
    return ids[best], dist[best]


def search(vectors: DataFrame, is_query, k: int = 10, trees: int = TREES, bits: int = BITS, share: float = SHARE, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every row for which ``is_query`` holds."""
    spark, vectors = vectors.sparkSession, usable(vectors)
    schema = "query_id long, vec_id long, score double"
    fitted = fit(vectors, trees, bits, SAMPLE)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    planes, offsets, dim = fitted
    vectors = vectors.where(F.size("v") == dim)
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    shared = spark.sparkContext.broadcast((planes, offsets))
    out, last = None, None
    while True:
        rows = (queries if last is None else queries.where(F.col("vec_id") > last)).orderBy("vec_id").limit(block).collect()
        if not rows and out is not None:
            break
        last = rows[-1].vec_id if rows else None
        # at most ``block`` vectors: a proven bound
        asked = spark.sparkContext.broadcast((np.asarray([r.vec_id for r in rows], np.int64), np.asarray([r.v for r in rows]).reshape(len(rows), dim)))

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            p, o = shared.value
            query_ids, q = asked.value
            if not len(query_ids):
                return
            codes = codes_of(q, p, o, trees, bits)
            best = [(np.empty(0, np.int64), np.empty(0))] * len(query_ids)

            def add(ids, x):
                forest = Forest(ids, x, p, o, trees, bits)
                for i, (a, d) in enumerate(forest.nearest(query_ids, q, codes, k, share, least)):
                    best[i] = smallest(np.concatenate([best[i][0], a]), np.concatenate([best[i][1], d]), k)

            held, size = [], 0
            for batch in batches:
                for s in range(0, batch.num_rows, SHARD):
                    part = batch.slice(s, SHARD)
                    held.append((part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(-1, dim)))
                    size += part.num_rows
                    if size >= SHARD:
                        add(*map(np.concatenate, zip(*held)))
                        held, size = [], 0
            if held:
                add(*map(np.concatenate, zip(*held)))
            counts = [len(a) for a, _ in best]
            columns = np.repeat(query_ids, counts), np.concatenate([a for a, _ in best]), np.concatenate([d for _, d in best])
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

        found = vectors.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
        if len(rows) < block:
            break
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
