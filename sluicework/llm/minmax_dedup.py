"""Near-duplicate documents by min-max hashing, with every link confirmed on full shingle sets.

1. A pass over the texts gives each document's set of word shingles as 64-bit hashes, the set's
   digest, and a signature: under each of ``PERMUTATIONS`` permutations both the minimum and the
   maximum are kept, so half the hash evaluations give a signature of twice the length. The
   values are banded; ``ROWS`` of them make a band.
2. Equal digests are one class (exact copies never meet again as pairs). Band values are dealt by
   value and sorted; buckets of one class are dropped as they stream by.
3. Classes that buckets tie together are a cluster. Links are confirmed by the sets themselves,
   never by signatures. A cluster that fits into one task is compared there at once. In a larger
   one each class first meets one other, the most popular one of its buckets, which shares most
   buckets with any: one pair a class, however large a group of near copies is. Then, wherever a
   bucket still holds unconnected classes, those outside its largest component are compared with
   all others, block by block in separate tasks, each of bounded size: by bucket, or over the whole
   cluster where its buckets overlap so much that this moves fewer sets. A block returns links that
   connect something, never pairs. No cap is set on buckets, partners or clusters.
4. Components of the confirmed links give each document its class's smallest doc_id.

With the default 54 bands of 6 values a pair at similarity 0.8 shares no bucket with probability
(1 - 0.8^6)^54, 8 in 10^8, and less above.

The sets are made again from the texts of those classes that share a bucket with another one;
a bitmap of fixed size picks them while the texts are read, so texts are never shuffled. Tables of
the way are deleted as soon as they have been read.

Edge cases: texts with fewer words than a shingle are one shingle; null or empty texts, or such
without words, have no shingle and are linked with nothing; rows without doc_id are linked with
nothing and kept; rows that share a doc_id count as one document with several texts, linked with
whatever any of them is, and each row is returned; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, claim, documents_of, written
from .components import components

BANDS, ROWS = 54, 6
PERMUTATIONS = BANDS * ROWS // 2
#: Columns of a set that are permuted at a time: bounds memory for very long texts.
BLOCK = 4096
#: Words whose hash a worker keeps. Bits of the bitmap of classes (a fixed size: 4 MB).
KEPT, BITMAP = 250_000, 1 << 25
#: Classes of a star that one task compares with its centre.
FAN = 128
#: Classes, and shingles of them, in a cluster that one task compares; in a block of those outside
#: the largest component; and in a block of all.
SMALL, OUTSIDE, ALL, SHINGLES = 192, 128, 256, 250_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT:
            self[word] = h
        return h


_hashes = _Hashes()
_hash_of = _hashes.__getitem__


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII only for both
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.asarray([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_hash_of, words), np.uint64, len(words))
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = _mixed(out) + h[k : k + n]
    return np.unique(_mixed(out))


@lru_cache(maxsize=4)
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 32, (count, 1), np.uint32), rng.integers(0, 1 << 31, (count, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Minimum and maximum of the set under each permutation: 2 * permutations values."""
    flip, factor = _permutations(permutations)
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32) * np.uint32(0x9E3779B1)
    low, high = np.full(permutations, 0xFFFFFFFF, np.uint32), np.zeros(permutations, np.uint32)
    for k in range(0, len(x), BLOCK):
        y = (x[None, k : k + BLOCK] ^ flip) * factor
        y ^= y >> np.uint32(15)
        np.minimum(low, y.min(axis=1), out=low)
        np.maximum(high, y.max(axis=1), out=high)
    return np.concatenate([low, high])


@lru_cache(maxsize=4)
def _band_order(bands: int, rows: int) -> np.ndarray:
    """Which values make which band: mixed, so that both ends of a permutation seldom meet in one."""
    return np.random.default_rng(99).permutation(bands * rows).reshape(bands, rows)


def band_values(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit value for each band, the band's number mixed in."""
    v = sig[_band_order(bands, rows)].astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        out = _mixed(out ^ v[:, k])
    return out.view(np.int64)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, digest, tag, bands) of every row; bands are null where the task has had the digest before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near duplicates", _hashes.clear)
        seen = set()
        for batch in batches:
            n, digests, tags, bands = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(text.as_py(), size)
                n.append(len(s))
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) and doc_id is not None else None
                digests.append(digest)
                tags.append(None if digest is None else int.from_bytes(digest[:4], "little", signed=True))
                if digest is None or digest in seen:
                    bands.append(None)
                else:
                    seen.add(digest)
                    bands.append(band_values(signature(s)))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(tags, pa.int32()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "digest", "tag", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, tag int, bands array<long>")


def _shared_buckets(signed: DataFrame) -> DataFrame:
    """(bucket, doc_id, first) of the buckets that hold two classes or more, a document of each class.

    ``first`` is the same one of them in every row of a bucket. Classes are told apart by 32 bits of
    their digest. Rows come sorted by bucket and tag, so a task holds no more than one batch, the
    last class before it with its bucket's first one, and whether it has been passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near duplicates", _hashes.clear)
        held, passed, head = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)], False, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            new = np.ones(len(rows[0]), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            b, tag, doc = (x[new] for x in rows)  # the first row of each class in a bucket
            keep = np.zeros(len(b), bool)
            keep[1:] = b[1:] == b[:-1]
            keep[:-1] |= keep[1:]
            if len(held[0]) and passed:
                keep[0] = False
            began = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))  # of each bucket
            first = doc[began]
            if len(held[0]):
                first[0] = head
            head = first[-1]
            first = np.repeat(first, np.diff(began, append=len(b)))
            # what has been passed on stays so while it is the last one
            passed = bool(keep[-1]) or (passed and len(b) == 1)
            held = [b[-1:], tag[-1:], doc[-1:]]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (b, doc, first)], names=["bucket", "doc_id", "first"])

    rows = signed.where("bands is not null").select(F.explode("bands").alias("bucket"), "tag", "doc_id")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "tag", "doc_id").mapInArrow(run, "bucket long, doc_id long, first long")


def _bits(ids: DataFrame) -> np.ndarray:
    """Bitmap of fixed size of the column ``node``: at most BITMAP / 64 rows come to the driver."""
    words = ids.select(F.pmod(F.xxhash64("node"), F.lit(BITMAP)).alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    out = np.zeros(BITMAP // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def _packed(shingles: np.ndarray) -> bytes:
    """A sorted set's hashes, of each the upper 48 bits: two sets of a million have one in common by chance in 280."""
    return shingles.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpacked(data) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, 2:] = six
    return out.view(np.uint64).ravel()


def _sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the wanted classes, made from their smallest document's text.

    Of a hundred other documents less than one comes along for every 300,000 wanted classes; joins
    leave them out.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_bits(nodes))  # BITMAP / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near duplicates", _hashes.clear)
        for batch in batches:
            bit = batch.column(2).to_numpy()
            on = np.flatnonzero(bits.value[bit >> 6] >> (bit & 63) & 1)
            for part in np.array_split(on, len(on) // 500 + 1):
                s = [_packed(shingle_set(batch.column(1)[int(k)].as_py(), size)) for k in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), pa.array(s, pa.binary())], names=["node", "shingles"])

    marked = docs.where("doc_id is not null").withColumn("bit", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(BITMAP)))
    return marked.mapInArrow(run, "node long, shingles binary")


def _linked_stars(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those links (u, v) of ``stars`` that the sets confirm; each u has one v.

    A centre v of very many u is dealt over several parts, its set copied to each of them.
    """
    parts = stars.groupBy("v").agg(F.ceil(F.count("*") / FAN).cast("int").alias("parts"))
    own = parts.select(F.col("v").alias("node"), F.col("v").alias("star"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("leaf"))
    leaves = stars.join(parts, "v").select(F.col("u").alias("node"), F.col("v").alias("star"), F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("leaf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near duplicates", _hashes.clear)
        centre: tuple = (None, [])
        for batch in batches:
            u, v = [], []
            for node, star, part, leaf, data in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                s = _unpacked(data.as_buffer())
                if centre[0] != (star, part):
                    centre = (star, part), []
                if not leaf:
                    centre[1].append(s)  # a document may have several texts
                elif any(_similar(s, c, percent) for c in centre[1]):
                    u.append(node)
                    v.append(star)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    rows = own.unionAll(leaves).join(sets, "node").select("node", "star", "part", "leaf", "shingles")
    return rows.repartition("star", "part").sortWithinPartitions("star", "part", "leaf", "node").mapInArrow(run, "u long, v long")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(both) - inter)


def _popular(buckets: DataFrame) -> DataFrame:
    """(u, v): for each class the most popular one of its buckets, if that isn't itself.

    A class's popularity is the sum of its buckets' sizes; of equal ones the smaller id counts more.
    """
    bucket, node = Window.partitionBy("bucket"), Window.partitionBy("node")
    rank = F.struct(F.sum("size").over(node).alias("p"), (-F.col("node")).alias("m"))
    ranked = buckets.withColumn("size", F.count("*").over(bucket)).select("bucket", "node", rank.alias("rank"))
    best = ranked.select("node", F.max("rank").over(bucket).alias("rank"))
    return best.groupBy("node").agg((-F.max("rank")["m"]).alias("v")).where("node <> v").select(F.col("node").alias("u"), "v")


def _linked_in(sets: list[np.ndarray], outside: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each set its place and those places ``outside`` that it is linked with.

    Intersections are counted over a sorted list of the elements of the sets outside.
    """
    sizes = np.asarray([len(x) for x in sets])
    elements = np.concatenate([sets[k] for k in outside])
    owner = np.repeat(np.arange(len(outside)), sizes[outside])
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    for m, own in enumerate(sets):
        low, high = np.searchsorted(elements, own, "left"), np.searchsorted(elements, own, "right")
        n = high - low
        hit = n > 0
        low, n = low[hit], n[hit]
        places = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        inter = np.bincount(owner[places], minlength=len(outside))
        found = outside[100 * inter >= percent * (sizes[m] + sizes[outside] - inter)]
        yield m, found[found != m]


def _compared(items: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of the components c that belong together, within each block (kind, g, i, j) of items (*block, node, c, outside).

    A component is named by its smallest class; each is linked with the smallest one of those it joins.
    """

    def block(rows: list[tuple]) -> list[tuple[int, int]]:
        parent = {r[1]: r[1] for r in rows}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        outside = np.flatnonzero([r[2] for r in rows])
        for m, found in _linked_in([r[3] for r in rows], outside, percent) if len(outside) else ():
            for o in found.tolist():
                x, y = root(rows[m][1]), root(rows[o][1])
                parent[max(x, y)] = min(x, y)
        return [(c, r) for c in parent if (r := root(c)) != c]  # components are named by one of their classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near duplicates", _hashes.clear)
        key, rows = None, []

        def links():
            found = block(rows)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for *now, node, c, out, data in zip(*(batch.column(k).to_pylist() for k in range(7)), batch.column(7)):
                if now != key and rows:
                    yield links()
                key = now
                rows.append((node, c, out, _unpacked(data.as_buffer())))
        if rows:
            yield links()

    key = ["kind", "g", "i", "j"]
    ordered = items.join(sets, "node").select(*key, "node", "c", "outside", "shingles").repartition(*key).sortWithinPartitions(*key, "node")
    return ordered.mapInArrow(run, "u long, v long")


def _blocks(k, shingles, most: int):
    return F.greatest(F.ceil(k / most), F.ceil(shingles / SHINGLES), F.lit(1)).cast("int")


def _groups(rows: DataFrame, key: str) -> DataFrame:
    """Per value of ``key`` the largest component, into how many blocks the classes outside it and all
    are cut, and how many sets that moves. Rows are (key, node, n, c, cluster), each once."""
    by = rows.groupBy(key, "cluster", "c").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    largest = F.struct("k", -F.col("c"))
    main = by.groupBy(key, "cluster").agg(F.max_by("c", largest).alias("main"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.max("k").alias("mk"), F.max_by("s", largest).alias("ms"))
    sized = main.where("k > mk").withColumn("out", F.col("k") - F.col("mk")).withColumn("ni", _blocks(F.col("out"), F.col("s") - F.col("ms"), OUTSIDE)).withColumn("nj", _blocks(F.col("k"), F.col("s"), ALL))
    return sized.select(key, "cluster", "main", "ni", "nj", (F.col("k") * F.col("ni") + F.col("out") * F.col("nj")).alias("moved"), (F.col("k") * F.col("out")).alias("pairs"))


def comparisons(rows: DataFrame) -> DataFrame:
    """The plan (kind, g, main, ni, nj, moved, pairs) of a large cluster's comparisons.

    rows: (bucket, node, n, c, cluster) of buckets with unconnected classes. kind 0: over the
    cluster g; kind 1: within bucket g. Of each cluster the kind that moves fewer sets is taken.
    """
    members = rows.select("cluster", F.col("cluster").alias("g"), "node", "n", "c").distinct()
    whole = _groups(members, "g").select(F.lit(0).alias("kind"), "*")
    within = _groups(rows.withColumnRenamed("bucket", "g"), "g").select(F.lit(1).alias("kind"), "*")
    both = whole.unionAll(within)
    cost = both.groupBy("cluster").agg(F.sum(F.when(F.col("kind") == 0, F.col("moved"))).alias("m0"), F.sum(F.when(F.col("kind") == 1, F.col("moved"))).alias("m1"))
    chosen = cost.select("cluster", F.when(F.col("m1") < F.col("m0"), 1).otherwise(0).alias("kind"))
    return both.join(chosen, ["cluster", "kind"]).select("kind", "g", "main", "ni", "nj", "moved", "pairs")


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(kind, g, i, j, node, c, outside): block i of those outside meets block j of all."""
    ends = rows.select(F.lit(1).alias("kind"), F.col("bucket").alias("g"), "node", "c").unionAll(rows.select(F.lit(0).alias("kind"), F.col("cluster").alias("g"), "node", "c").distinct())
    at = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = ends.join(plan, ["kind", "g"]).withColumn("out", F.col("c") != F.col("main")).withColumn("oi", at("ni", 1)).withColumn("aj", at("nj", 2))
    # where a class would come to a task as both, it comes as one outside
    as_all = placed.select("kind", "g", F.explode(every("ni")).alias("i"), F.col("aj").alias("j"), "node", "c", "out", "oi").where("not (out and i = oi)")
    as_out = placed.where("out").select("kind", "g", F.col("oi").alias("i"), F.explode(every("nj")).alias("j"), "node", "c")
    return as_all.select("kind", "g", "i", "j", "node", "c", F.lit(False).alias("outside")).unionAll(as_out.withColumn("outside", F.lit(True)))


def _links(buckets: DataFrame, ties: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, t: Scratch) -> list[DataFrame]:
    """Tables of confirmed links (u, v) that connect whatever is connected.

    buckets: (bucket, node); ties: pairs (u, v) that connect each bucket; sizes: (node, n).
    """
    ties = components(ties).withColumnRenamed("component", "cluster")
    nodes = t.put(ties.join(sizes, "node"), "clusters")
    large = t.put(nodes.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("s")).where(f"k > {SMALL} or s > {SHINGLES} and k > 2").select("cluster"), "large")
    zero = F.lit(0)
    small = nodes.join(large, "cluster", "left_anti").select(zero.alias("kind"), F.col("cluster").alias("g"), zero.alias("i"), zero.alias("j"), "node", F.col("node").alias("c"), F.lit(True).alias("outside"))
    links = [t.put(_compared(small, sets, percent), "links")]
    if not large.isEmpty():
        rows = t.put(buckets.join(nodes.join(large, "cluster", "left_semi"), "node"), "rows")
        near = _popular(rows.select("bucket", "node")).join(sizes.select(F.col("node").alias("u"), F.col("n").alias("nu")), "u").join(sizes.select(F.col("node").alias("v"), F.col("n").alias("nv")), "v")
        # sizes alone forbid a link unless one is within the percentage of the other
        stars = t.put(near.where(F.expr(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")).select("u", "v"), "stars")
        links.append(t.put(_linked_stars(stars, sets, percent), "links"))
        labelled = rows.join(components(links[1]), "node", "left").select("bucket", "node", "n", "cluster", F.coalesce("component", "node").alias("c"))
        within = Window.partitionBy("bucket")
        mixed = labelled.withColumn("c0", F.min("c").over(within)).withColumn("c1", F.max("c").over(within))
        open_ = t.put(mixed.where("c0 <> c1").drop("c0", "c1"), "open")
        plan = t.put(comparisons(open_), "plan")
        links.append(t.put(_compared(_placed(open_, plan), sets, percent), "links"))
        t.drop(rows, stars, open_, plan)
    t.drop(nodes, large)
    return links


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; linked: 100 * intersection >= percent * union."""
    docs, t = documents_of(docs), Scratch(docs.sparkSession)
    signed = t.put(_signed(docs, shingle), "signed")
    met = t.put(_shared_buckets(signed), "buckets")
    least = t.put(signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    ids = written(signed.select("doc_id", "n", "digest").join(least, "digest", "left").select("doc_id", "n", "node"), "ids")
    t.drop(signed, least)
    of_doc = ids.where("node is not null").select("doc_id", "node").distinct()
    heads = of_doc.select(F.col("doc_id").alias("first"), F.col("node").alias("v"))
    buckets = t.put(met.join(of_doc, "doc_id").select("bucket", "node").distinct(), "buckets")
    ties = t.put(met.select("doc_id", "first").distinct().join(of_doc, "doc_id").join(heads, "first").select(F.col("node").alias("u"), "v").where("u <> v").distinct(), "ties")
    t.drop(met)
    sets = t.put(_sets_of(docs, buckets.select("node").distinct(), shingle), "sets")
    sizes = ids.where("doc_id = node").groupBy("node").agg(F.max("n").alias("n"))
    links = _links(buckets, ties, sizes, sets, percent, t)
    # texts that share a doc_id
    shared = of_doc.groupBy("doc_id").agg(F.count("*").alias("k"), F.min("node").alias("v")).where("k > 1").select("doc_id", "v")
    several = of_doc.join(shared, "doc_id").select(F.col("node").alias("u"), "v")
    everything = several
    for table in links:
        everything = everything.unionAll(table)
    found = components(everything)
    t.drop(buckets, ties, sets, *links)
    return (
        ids.join(found, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; all columns as they were.

    Rows that the fixed-size bitmap of dropped ids clears stay where they are read; only those it
    may hold are joined with the ids themselves.
    """
    found = near_duplicates(docs, shingle, percent)
    taken = {c.lower() for c in docs.columns}
    node, mark = (next(x for x in (name + "_" * k for k in range(len(taken) + 1)) if x not in taken) for name in ("node", "bit"))
    dropped = written(found.where("not kept").select(F.col("doc_id").alias("node")).distinct(), "dropped")
    bits = docs.sparkSession.sparkContext.broadcast(_bits(dropped))  # BITMAP / 8 bytes

    def part(held: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("near duplicates", _hashes.clear)
            for batch in batches:
                bit = batch.column(batch.num_columns - 1).to_numpy()
                on = (bits.value[bit >> 6] >> (bit & 63) & 1) == held
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(on))

        return docs.select("*", F.pmod(F.xxhash64(docs["doc_id"].cast("long")), F.lit(BITMAP)).alias(mark)).mapInArrow(run, docs.schema)

    maybe = part(True).join(dropped.withColumnRenamed("node", node), F.col("doc_id").cast("long") == F.col(node), "left_anti")
    return part(False).unionAll(maybe)
