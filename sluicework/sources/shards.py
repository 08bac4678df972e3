"""Data source ``tokenshard``: packed token ids in .bin files, each with an .idx of its documents.

An index holds a 9-byte magic, version, type code, the number of sequences and documents, then
lengths (int32), byte pointers (int64) and document numbers (int64, one more than documents).

Writing: every task writes one pair for each slug it has rows of, under a name of its own below
``_parts``; on commit the pairs are moved into place in task order, so the documents of
``<slug>-00000``, ``-00001``, ... follow each other. Rows must come in order: range-partition by
slug and doc_seq first. An aborted or repeated task leaves nothing behind. No ids pass through
the driver. ``merge_all`` makes one pair of each slug's pairs, a task for each slug. Paths may be of
any file system that pyarrow knows.

Reading: a partition for each pair; every header field is checked. ``documents_at`` and ``spans_at``
read single documents and spans by their pointers, whatever the shard's size.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MAGIC, VERSION, UINT16 = b"MMIDIDX\0\0", 1, 8
HEADER = struct.Struct("<9sQBQQ")
SCHEMA = "slug string, part int, doc_seq bigint, seq_len bigint, data binary"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def index_bytes(lengths: np.ndarray) -> bytes:
    """An index for documents of these lengths, stored one after another."""
    n, lengths = len(lengths), np.asarray(lengths, "<i4")
    pointers = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)[:-1] * 2]) if n else np.empty(0)
    return HEADER.pack(MAGIC, VERSION, UINT16, n, n) + lengths.tobytes() + pointers.astype("<i8").tobytes() + np.arange(n + 1, dtype="<i8").tobytes()


def parse_header(head: bytes, name: str) -> int:
    """Number of documents; anything unexpected is an error."""
    if len(head) < HEADER.size:
        raise ValueError(f"{name}: the index is cut short")
    magic, version, kind, sequences, documents = HEADER.unpack(head[: HEADER.size])
    if magic != MAGIC or version != VERSION or kind != UINT16 or sequences != documents:
        raise ValueError(f"{name}: no index of this kind")
    return sequences


def read_lengths(path: str) -> np.ndarray:
    """Document lengths of an index, without reading the rest."""
    filesystem, p = _open(path)
    with filesystem.open_input_file(p) as f:
        n = parse_header(f.read(HEADER.size), path)
        return np.frombuffer(f.read(4 * n), "<i4")


def read_index(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, pointers and document numbers, each checked."""
    filesystem, p = _open(path)
    with filesystem.open_input_file(p) as f:
        data = f.read()
    n = parse_header(data, path)
    if len(data) != HEADER.size + 4 * n + 8 * n + 8 * (n + 1):
        raise ValueError(f"{path}: wrong length for {n} documents")
    lengths = np.frombuffer(data, "<i4", n, HEADER.size)
    pointers = np.frombuffer(data, "<i8", n, HEADER.size + 4 * n)
    documents = np.frombuffer(data, "<i8", n + 1, HEADER.size + 12 * n)
    if n and (pointers[0] != 0 or (np.diff(pointers) != 2 * lengths[:-1].astype(np.int64)).any()):
        raise ValueError(f"{path}: pointers don't follow from the lengths")
    return lengths, pointers, documents


def merge_parts(path: str, slug: str) -> None:
    """Makes ``<slug>.bin`` and ``<slug>.idx`` of the slug's pairs, then deletes those."""
    filesystem, root = _open(path)
    parts = sorted(p for p in _pairs(filesystem, root) if p[0] == slug)
    lengths = []
    with filesystem.open_output_stream(f"{root}/{slug}.bin.tmp") as out:
        for _, _, base in parts:
            with filesystem.open_input_stream(f"{base}.bin") as f:
                while block := f.read(1 << 24):
                    out.write(block)
            with filesystem.open_input_file(f"{base}.idx") as f:
                lengths.append(np.frombuffer(f.read(), "<i4", parse_header(f.read_at(HEADER.size, 0), base), HEADER.size))
    with filesystem.open_output_stream(f"{root}/{slug}.idx") as f:
        f.write(index_bytes(np.concatenate(lengths) if lengths else np.empty(0)))
    filesystem.move(f"{root}/{slug}.bin.tmp", f"{root}/{slug}.bin")
    for _, _, base in parts:
        for end in ("bin", "idx"):
            if base != f"{root}/{slug}":
                filesystem.delete_file(f"{base}.{end}")


def merge_all(spark, path: str) -> None:
    """``merge_parts`` of every slug below ``path``: each in a task, no byte through the driver."""
    filesystem, root = _open(path)
    slugs = sorted({p[0] for p in _pairs(filesystem, root)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slug in batch.column(0).to_pylist():
                merge_parts(path, slug)
            yield batch

    if slugs:
        spark.createDataFrame([(s,) for s in slugs], "slug string").repartition(len(slugs), "slug").mapInArrow(run, "slug string").count()


class _Shard:
    """The pairs of one slug, their indexes read once."""

    def __init__(self, path: str, slug: str):
        self.filesystem, root = _open(path)
        prefix = path.split("://")[0] + "://" if "://" in path else ""
        self.bases = [base for name, _, base in sorted(_pairs(self.filesystem, root)) if name == slug]
        self.slug, self.index = slug, [read_index(f"{prefix}{base}.idx")[:2] for base in self.bases]
        self.documents = np.cumsum([0, *(len(n) for n, _ in self.index)])
        self.tokens = np.cumsum([0, *(int(n.sum()) for n, _ in self.index)])

    def _read(self, pair: int, at: int, size: int) -> bytes:
        with self.filesystem.open_input_file(f"{self.bases[pair]}.bin") as f:
            return f.read_at(size, at)

    def document(self, doc_seq: int) -> bytes:
        if not 0 <= doc_seq < self.documents[-1]:
            raise ValueError(f"{self.slug} has {self.documents[-1]} documents, not {doc_seq + 1}")
        pair = int(np.searchsorted(self.documents, doc_seq, "right")) - 1
        lengths, pointers = self.index[pair]
        k = doc_seq - int(self.documents[pair])
        return self._read(pair, int(pointers[k]), 2 * int(lengths[k]))

    def span(self, start: int, length: int) -> bytes:
        if start < 0 or start + length > self.tokens[-1]:
            raise ValueError(f"{self.slug}: span of {length} tokens from {start} ends after the shard")
        out, pair = [], int(np.searchsorted(self.tokens, start, "right")) - 1
        while length:
            size = min(length, int(self.tokens[pair + 1]) - start)
            out.append(self._read(pair, 2 * (start - int(self.tokens[pair])), 2 * size))
            start, length, pair = start + size, length - size, pair + 1
        return b"".join(out)


def documents_at(requests, path: str):
    """(slug, doc_seq, data) of rows (slug, doc_seq): each read by its pointer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, _Shard] = {}
        for batch in batches:
            slugs = batch.column(0).to_pylist()
            for s in set(slugs) - set(shards):
                shards[s] = _Shard(path, s)
            data = [shards[s].document(k) for s, k in zip(slugs, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=["slug", "doc_seq", "data"])

    return requests.selectExpr("slug", "cast(doc_seq as bigint) as doc_seq").mapInArrow(run, "slug string, doc_seq bigint, data binary")


def spans_at(requests, path: str):
    """(slug, start, length, data) of rows (slug, start, length): tokens across documents; past the end is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, _Shard] = {}
        for batch in batches:
            slugs = batch.column(0).to_pylist()
            for s in set(slugs) - set(shards):
                shards[s] = _Shard(path, s)
            data = [shards[s].span(a, n) for s, a, n in zip(slugs, batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=["slug", "start", "length", "data"])

    return requests.selectExpr("slug", "cast(start as bigint) as start", "cast(length as bigint) as length").mapInArrow(run, "slug string, start bigint, length bigint, data binary")


def index_lengths(spark, path: str):
    """(slug, part, n_docs, n_tokens, longest) of every pair, from the lengths in its index alone."""
    filesystem, root = _open(path)
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    pairs = [(slug, part, f"{prefix}{base}.idx") for slug, part, base in sorted(_pairs(filesystem, root))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [read_lengths(p) for p in batch.column(2).to_pylist()]
            numbers = [pa.array([f(n) for n in lengths], pa.int64()) for f in (len, lambda n: int(n.sum()), lambda n: int(n.max(initial=0)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers], names=["slug", "part", "n_docs", "n_tokens", "longest"])

    return spark.createDataFrame(pairs, "slug string, part int, path string").mapInArrow(run, "slug string, part int, n_docs bigint, n_tokens bigint, longest bigint")


def _pairs(filesystem: fs.FileSystem, root: str) -> list[tuple[str, int, str]]:
    """(slug, part, path without ending) of the pairs in a folder."""
    found = []
    for info in filesystem.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.endswith(".idx"):
            stem = info.base_name[:-4]
            slug, dash, part = stem.rpartition("-")
            numbered = dash and len(part) == 5 and part.isdigit()
            found.append((slug, int(part), f"{root}/{stem}") if numbered else (stem, 0, f"{root}/{stem}"))
    return found


@dataclass
class Written(WriterCommitMessage):
    task: int
    files: list[tuple[str, str]]  # slug, path without ending


@dataclass
class Pair(InputPartition):
    slug: str
    part: int
    base: str
    first: int  # documents of the slug before it


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        filesystem, root = _open(self.path)
        folder = f"{root}/_parts/{self.job}"
        filesystem.create_dir(folder, recursive=True)
        files, lengths, out, now = [], [], None, None

        def close():
            if out is not None:
                out.close()
                with filesystem.open_output_stream(f"{files[-1][1]}.idx") as f:
                    f.write(index_bytes(np.asarray(lengths)))

        for batch in iterator:
            slugs, data = batch.column("slug").to_pylist(), batch.column("data")
            for slug, ids in zip(slugs, data):
                if slug != now:
                    close()
                    now, lengths = slug, []
                    files.append((slug, f"{folder}/{context.partitionId()}-{context.attemptNumber()}-{len(files)}"))
                    out = filesystem.open_output_stream(f"{files[-1][1]}.bin")
                ids = ids.as_buffer()
                out.write(ids)
                lengths.append(len(ids) // 2)
        close()
        return Written(context.partitionId(), files)

    def commit(self, messages: list[Written | None]) -> None:
        filesystem, root = _open(self.path)
        if self.overwrite:
            for _, _, base in _pairs(filesystem, root):
                filesystem.delete_file(f"{base}.idx")
                filesystem.delete_file(f"{base}.bin")
        number: dict[str, int] = {}
        for slug, part, _ in _pairs(filesystem, root):
            number[slug] = max(number.get(slug, 0), part + 1)
        for message in sorted((m for m in messages if m), key=lambda m: m.task):
            for slug, base in message.files:
                k = number[slug] = number.get(slug, 0) + 1
                for end in ("bin", "idx"):
                    filesystem.move(f"{base}.{end}", f"{root}/{slug}-{k - 1:05d}.{end}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        filesystem, root = _open(self.path)
        filesystem.delete_dir_contents(f"{root}/_parts/{self.job}", missing_dir_ok=True)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Pair]:
        """Reads each index's header only."""
        filesystem, root = _open(self.path)
        out, first = [], {}
        for slug, part, base in sorted(_pairs(filesystem, root)):
            with filesystem.open_input_file(f"{base}.idx") as f:
                n = parse_header(f.read(HEADER.size), base)
            out.append(Pair(slug, part, base, first.get(slug, 0)))
            first[slug] = first.get(slug, 0) + n
        return out

    def read(self, partition: Pair) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _open(self.path)
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        lengths, pointers, _ = read_index(f"{prefix}{partition.base}.idx")
        with filesystem.open_input_file(f"{partition.base}.bin") as f:
            if f.size() != 2 * int(lengths.sum()):
                raise ValueError(f"{partition.base}.bin: its size isn't what the index says")
            for k in range(0, len(lengths), 1024):
                data = [f.read(2 * int(n)) for n in lengths[k : k + 1024]]
                m = len(data)
                yield pa.RecordBatch.from_arrays([pa.array([partition.slug] * m), pa.array([partition.part] * m, pa.int32()), pa.array(range(partition.first + k, partition.first + k + m), pa.int64()), pa.array(lengths[k : k + m], pa.int64()), pa.array(data, pa.binary())], names=["slug", "part", "doc_seq", "seq_len", "data"])


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokenshard"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def write_shards(tokens, path: str) -> None:
    """Writes (slug, doc_seq, seq_len, data), in order of doc_seq within each slug."""
    tokens.sparkSession.dataSource.register(TokenShards)
    ordered = tokens.select("slug", "doc_seq", "data").repartitionByRange("slug", "doc_seq").sortWithinPartitions("slug", "doc_seq")
    ordered.write.format("tokenshard").mode("append").save(path)


def read_shards(spark, path: str):
    spark.dataSource.register(TokenShards)
    return spark.read.format("tokenshard").load(path)
