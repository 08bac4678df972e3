"""Content-addressed store of token ids.

``write_store`` encodes every text, ends it with ``end_id`` and cuts the id stream where a rolling
hash of the last ``WINDOW`` ids is below a limit, so equal passages give equal chunks
wherever they stand. A chunk's address is the digest of its ids. The store has three tables:

* ``objects``: each distinct chunk once (address, ids), and each document's recipe (its addresses);
* ``manifest``: the recipes in ascending doc_id order in numbered parts, each with its length, its
  start within the part and the Merkle root of its addresses;
* ``parts``: for each part the documents, ids, ids before it and the Merkle root of its documents.

Texts are encoded once. Chunk ids cross one shuffle, by address, at most once from each task;
recipes and everything later carry addresses only. Ids take two bytes where the vocabulary allows.

``verify`` reads the files back: every chunk is hashed again and held against its address, every
document's root and length against the manifest, and the documents' checksums are put together
from those of their chunks. ``read_documents`` returns the ids themselves.

Edge cases: a null or empty text is a document of the end id alone; repeated rows and repeated
doc_ids are documents of their own with shared chunks; a null doc_id sorts first; an empty table
makes an empty store; other columns are not read. A missing or damaged chunk fails the read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, documents_of
from .vocabulary import piece_encoder

#: Ids that the rolling hash sees; ids of a chunk on average, at least and at most.
WINDOW, MEAN, LEAST, MOST = 6, 512, 64, 4096
FACTORS = np.asarray([pow(0x2C1B3C6D, k + 1, 1 << 32) for k in range(WINDOW)], np.uint32)
#: Addresses that a task remembers, not to send a chunk twice; whatever it sends, each is stored once.
SEEN = 1 << 18
OBJECTS = "bucket long, doc_id long, addresses array<binary>, lengths array<int>, address binary, ids binary, n_ids int"
MANIFEST = "part int, row int, doc_id long, local_start long, n_tokens long, root binary, addresses array<binary>, lengths array<int>"


def address_of(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=16).digest()


def cut_points(ids: np.ndarray, ends: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of documents laid end to end, which end at ``ends`` (one document, if not given).

    The hash's window may reach back into the document before only where a chunk would be too short.
    """
    n = len(ids)
    if not n:
        return []
    mixed = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    rolling = mixed * FACTORS[0]
    for k in range(1, min(WINDOW, n)):  # the hash of the window that ends at each id
        rolling[k:] += mixed[: n - k] * FACTORS[k]
    ends = np.asarray([n]) if ends is None else ends
    places = np.union1d(np.flatnonzero(rolling < np.uint32((1 << 32) // MEAN)) + 1, ends)
    out, start = [], 0
    for place, last in zip(places.tolist(), np.isin(places, ends).tolist()):
        while place - start > MOST:
            start += MOST
            out.append(start)
        if last or place - start >= LEAST:
            out.append(place)
            start = place
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over the leaves' digests; an odd one moves up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [b"\0" * 16]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[k : k + 2]), digest_size=16).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the crc's, bits reflected, one by one."""
    a, b = np.broadcast_arrays(np.asarray(a, np.uint32), np.asarray(b, np.uint32))
    out, b, one = np.zeros(a.shape, np.uint32), b.copy(), np.uint32(1)
    for bit in range(31, -1, -1):
        out ^= b & -(a >> np.uint32(bit) & one)
        b = (b >> one) ^ (np.uint32(0xEDB88320) & -(b & one))
    return out


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """x to the power of the bits of 0, 1, ... MOST ids of four bytes."""
    out = np.full(1, 1 << 31, np.uint32)  # x^0
    step = np.full(1, 1 << 23, np.uint32)  # x^8
    step = _times(*[_times(step, step)] * 2)  # of a whole id
    while len(out) <= MOST:  # twice as many each time; step is x^(32 * len(out))
        out, step = np.concatenate([out, _times(out, step)]), _times(step, step)
    return out[: MOST + 1]


def joined_crc32(crcs: np.ndarray, n_ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of the ids of each document from those of its chunks; ``ends``: where each document's chunks end.

    Neighbours are put together, level by level, so a document of very many chunks takes few steps.
    """
    crcs, shift = crcs.astype(np.uint32), _shifts()[n_ids]
    counts = np.diff(ends, prepend=0)
    while len(counts) and counts.max() > 1:
        doc = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        second = np.flatnonzero(place % 2 == 1)
        crcs[second - 1] = _times(crcs[second - 1], shift[second]) ^ crcs[second]
        shift[second - 1] = _times(shift[second - 1], shift[second])
        first = place % 2 == 0
        crcs, shift, counts = crcs[first], shift[first], (counts + 1) // 2
    return crcs.astype(np.int64)


def _binary(data, stops: np.ndarray) -> pa.Array:
    """Values that lie end to end in ``data`` and end at ``stops``."""
    offsets = np.concatenate([[0], stops]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _values(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Bytes of a column of binaries without nulls, and the places in them where its values begin and end."""
    _, offsets, data = column.cast(pa.binary()).buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(data if data is not None else b""), at


def _objects(doc_ids: list, encoded: list[bytes], width: str, seen: set) -> Iterator[pa.RecordBatch]:
    """Recipes of documents, and those of their chunks whose address is new."""
    names, types = [x.split()[0] for x in OBJECTS.split(", ")], [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32()]
    data = b"".join(encoded)
    ids, view = np.frombuffer(data, "<u4"), memoryview(data)
    doc_ends = np.cumsum([len(x) // 4 for x in encoded])
    stops = np.asarray(cut_points(ids, doc_ends))
    starts = np.concatenate([[0], stops[:-1]])
    addresses = [hashlib.blake2b(view[4 * a : 4 * b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops.tolist())]
    flat = b"".join(addresses)
    heads, n = np.frombuffer(flat, "<i8")[::2], len(addresses)
    offsets = np.concatenate([[0], np.searchsorted(stops, doc_ends, "right")])  # of each document's chunks
    lists = pa.array(offsets, pa.int32())
    of_doc = heads[offsets[:-1]] ^ np.asarray([k or 0 for k in doc_ids], np.int64)
    recipes = [pa.array(of_doc), pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(lists, _binary(flat, 16 * np.arange(1, n + 1))), pa.ListArray.from_arrays(lists, pa.array(stops - starts, pa.int32()))]
    yield pa.RecordBatch.from_arrays([*recipes, *(pa.nulls(len(doc_ids), t) for t in types[4:])], names=names)
    new = []
    for k, a in enumerate(addresses):
        if a not in seen:
            seen.add(a)
            new.append(k)
    if len(seen) > SEEN:
        seen.clear()
    if new:
        short, at = memoryview(ids.astype(width)).cast("B"), int(width[-1])
        chunks = b"".join([short[at * a : at * b] for a, b in zip(starts[new].tolist(), stops[new].tolist())])
        lengths = (stops - starts)[new]
        columns = [_binary(b"".join([addresses[k] for k in new]), 16 * np.arange(1, len(new) + 1)), _binary(chunks, at * np.cumsum(lengths)), pa.array(lengths, pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(heads[new]), *(pa.nulls(len(new), t) for t in types[1:4]), *columns], names=names)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    spark = docs.sparkSession
    end = np.asarray([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("encoding", piece_encoder.cache_clear)
        encoder, seen = piece_encoder(tokenizer_path), set()
        width = "<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            doc_ids, ids, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                ids.append(encoder.encode(text.as_py()) + end)
                size += len(ids[-1])
                if size > 1 << 20:
                    yield from _objects(doc_ids, ids, width, seen)
                    doc_ids, ids, size = [], [], 0
            if doc_ids:
                yield from _objects(doc_ids, ids, width, seen)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # addresses of one partition
        for batch in batches:
            keep = []
            for k, a in enumerate(batch.column(4).to_pylist()):
                if a is None or a not in seen:
                    keep.append(k)
                    seen.add(a)
            yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int32()))

    objects = documents_of(docs).mapInArrow(encoded, OBJECTS).repartition("bucket").mapInArrow(once, OBJECTS)
    objects.drop("bucket").write.option("compression", "zstd").parquet(f"{path}/objects")

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            addresses, lengths = batch.column(1), batch.column(2)
            n = np.add.reduceat(lengths.flatten().to_numpy(), np.cumsum(addresses.value_lengths().to_numpy()) - addresses.value_lengths().to_numpy(), dtype=np.int64) if batch.num_rows else np.empty(0, np.int64)
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            roots = [merkle_root(a) for a in addresses.to_pylist()]
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(range(row, row + k), pa.int32()), batch.column(0), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(roots, pa.binary()), addresses, lengths], names=[x.split()[0] for x in MANIFEST.split(", ")])
            row += k

    recipes = spark.read.parquet(f"{path}/objects").where("addresses is not null").select("doc_id", "addresses", "lengths")
    # the addresses break ties between equal doc_ids, so the order is the same on every attempt
    ordered = recipes.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "addresses")
    ordered.mapInArrow(framed, MANIFEST).write.option("compression", "zstd").parquet(f"{path}/manifest")

    # a row for each part, however many documents there are; parts are numbered in doc_id order
    manifest = spark.read.parquet(f"{path}/manifest")
    counts = manifest.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids")).orderBy("part").collect()
    first, parts = 0, []
    for p in counts:
        parts.append((p.part, p.n_docs, p.n_ids, first))
        first += p.n_ids
    spark.createDataFrame(parts, "part int, n_docs long, n_ids long, first_start long").coalesce(1).write.parquet(f"{path}/parts")


def _pieces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunks, and (document, place, address, length) of the recipes with each document's start."""
    chunks = spark.read.parquet(f"{path}/objects").where("address is not null").select("address", "ids", "n_ids")
    parts = spark.read.parquet(f"{path}/parts").select("part", "first_start")
    manifest = spark.read.parquet(f"{path}/manifest")
    # one row for each part of the manifest: as many as the writing job had tasks
    placed = manifest.join(F.broadcast(parts), "part").select("part", "row", "doc_id", (F.col("first_start") + F.col("local_start")).alias("start"), "n_tokens", "root", F.posexplode("addresses").alias("place", "address"))
    return chunks, placed


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(address, ids, n_ids) -> (address, n_ids, crc of the ids as 32-bit numbers), each chunk hashed again."""
    for batch in batches:
        data, at = _values(batch.column(1))
        n = batch.column(2).to_numpy()
        width = 2 if len(n) and at[-1] - at[0] < 4 * n.sum() else 4  # what most chunks have; another one is damaged
        spans, crcs = np.diff(at), []
        whole = memoryview(np.frombuffer(data[at[0] : at[-1]], f"<u{width}").astype("<u4")).cast("B") if (spans == width * n).all() else None
        for k, a in enumerate(batch.column(0).to_pylist()):
            start = (at[k] - at[0]) // width * 4
            ids = whole[start : start + 4 * int(n[k])] if whole is not None else _widened(data[at[k] : at[k + 1]], int(n[k]))
            if ids is None or hashlib.blake2b(ids, digest_size=16).digest() != a:
                raise ValueError(f"chunk {a.hex()} is damaged")
            crcs.append(zlib.crc32(ids))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(crcs, pa.int64())], names=["address", "n_ids", "crc"])


def _widened(data: memoryview, n: int) -> bytes | None:
    """``n`` ids of two or four bytes as 32-bit numbers; None if there aren't so many."""
    return np.frombuffer(data, f"<u{len(data) // n}").astype("<u4").tobytes() if n and len(data) in (2 * n, 4 * n) else None


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunks, doc_ids = batch.column(4), batch.column(0).to_pylist()
        counts = chunks.value_lengths().to_numpy()
        ends, flat = np.cumsum(counts), chunks.flatten()
        address, n_ids, crc = (flat.field(k) for k in ("address", "n_ids", "crc"))
        if crc.null_count:
            at = int(np.flatnonzero(crc.is_null().to_numpy(zero_copy_only=False))[0])
            raise ValueError(f"document {doc_ids[int(np.searchsorted(ends, at, 'right'))]}: a chunk is missing")
        n = n_ids.to_numpy()
        total = np.add.reduceat(n, ends - counts, dtype=np.int64) if len(n) else np.empty(0, np.int64)
        address, start = address.to_pylist(), 0
        for doc_id, stop, has, said, root in zip(doc_ids, ends.tolist(), total.tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if has != said or merkle_root(address[start:stop]) != root:
                raise ValueError(f"document {doc_id}: its chunks don't give what the manifest says")
            start = stop
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(joined_crc32(crc.to_numpy(), n, ends), pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, everything held against the manifest."""
    chunks, placed = _pieces(spark, path)
    sums = chunks.mapInArrow(_checked, "address binary, n_ids int, crc long")
    documents = (
        placed.join(sums, "address", "left")
        .groupBy("part", "row", "doc_id", "start", "n_tokens", "root")
        .agg(F.array_sort(F.collect_list(F.struct("place", "address", "n_ids", "crc"))).alias("chunks"))
    )
    return documents.select("doc_id", "start", "n_tokens", "root", "chunks").mapInArrow(_verified, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the documents as they were written, end id included."""
    chunks, placed = _pieces(spark, path)
    documents = placed.join(chunks, "address").groupBy("part", "row", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("place", "ids", "n_ids"))).alias("chunks"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(c["ids"], "<u2" if len(c["ids"]) == 2 * c["n_ids"] else "<u4").astype(np.int64) for c in row]) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return documents.select("doc_id", "start", "chunks").mapInArrow(joined, "doc_id long, start long, ids array<long>")
