"""Packing by the sum-of-squares rule.

Each document's ids fill whole windows of ``capacity`` ids; what is left over (under one window)
is placed online into a partly filled window. ``levels[h]`` counts the open windows that hold
``h`` ids, and the rest goes where the sum of squares of those counts becomes smallest, so open
windows stay spread over all levels and nearly every rest finds one it completes.

Every task packs the rows of its own input split: nothing is shuffled and a lost task is packed
again from the same split to the same result. When a split ends, the ids of the open windows are
laid out once more, fullest first, each filled up with ids cut from the emptiest; at most one
window of a split stays open, and that one is cut into lengths that are powers of two, which
need no padding.

Edge cases: null and empty texts are a document of the end id alone; rows repeated in the input
are packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import claim, documents_of
from .vocabulary import piece_encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids are the task's number times this plus a running number of the task.
PER_TASK = 1 << 36


class SumOfSquares:
    """The online rule over a level array; says which level a rest of ``size`` ids goes to."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)

    def place(self, size: int) -> int:
        """Level (ids already there) of the window that takes a rest of 0 < size < capacity; 0: a new one.

        The sum of squares grows by 2 (N(h + s) - N(h)) + 2, by 1 - 2 N(h) where the window is
        completed, and by 2 N(s) + 1 for a new one. Of equal choices the fullest window is taken.
        """
        n, c, s = self.levels, self.capacity, size
        growth = 2 * (n[s : c + 1] - n[: c + 1 - s]) + 2
        growth[-1] = 1 - 2 * n[c - s]
        growth[1:][n[1 : c + 1 - s] == 0] = np.iinfo(np.int64).max
        growth[0] = 2 * n[s] + 1
        best = len(growth) - 1 - int(np.argmin(growth[::-1]))
        if best:
            n[best] -= 1
        if best + s < c:
            n[best + s] += 1
        return best


def powers_of_two(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Packs (doc_id, ids) online; ``emit`` gets rows of SCHEMA as tuples.

    Holds the ids of open windows only, at the worst the rests of one split.
    """

    def __init__(self, capacity: int, first_id: int, emit: Callable[[tuple], None]):
        self.capacity, self.emit, self.next_id = capacity, emit, first_id
        self.rule = SumOfSquares(capacity)
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)

    def _sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.emit((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, c = len(ids) // 4, self.capacity
        whole = total // c * c
        for start in range(0, whole, c):
            self._sequence([(doc_id, start, ids[4 * start : 4 * (start + c)], total)])
        if size := total - whole:
            level = self.rule.place(size)
            window = self.open[level].pop() if level else []
            window.append((doc_id, whole, ids[4 * whole :], total))
            if level + size == c:
                self._sequence(window)
            else:
                self.open[level + size].append(window)

    def finish(self) -> None:
        """Fills the fullest open windows with ids cut from the emptiest ones."""
        windows = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open.clear()
        full = sum(len(p[2]) // 4 for w in windows for p in w) // self.capacity
        pieces = [p for w in windows[full:] for p in w][::-1]  # the next one is at the end
        for window in windows[:full]:
            self._sequence(window + self._cut(pieces, self.capacity - sum(len(p[2]) // 4 for p in window)))
        for size in powers_of_two(sum(len(p[2]) // 4 for p in pieces)):
            self._sequence(self._cut(pieces, size))

    @staticmethod
    def _cut(pieces: list[tuple], size: int) -> list[tuple]:
        """Takes ``size`` ids off the end of the list, cutting the last document taken."""
        out = []
        while size:
            doc_id, start, ids, total = pieces.pop()
            take = min(size, len(ids) // 4)
            out.append((doc_id, start, ids[: 4 * take], total))
            if take < len(ids) // 4:
                pieces.append((doc_id, start + take, ids[4 * take :], total))
            size -= take
        return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Every text, encoded and ended by ``end_id``, in sequences of at most ``capacity`` ids."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("encoding", piece_encoder.cache_clear)
        encoder, rows = piece_encoder(tokenizer_path), []
        context = TaskContext.get()
        packer = Packer(capacity, (context.partitionId() if context else 0) * PER_TASK, rows.append)

        def flush():
            columns = list(zip(*rows)) if rows else [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, encoder.encode(text.as_py()) + end)
            if rows:
                yield flush()
        packer.finish()
        if rows:
            yield flush()

    return documents_of(docs).mapInArrow(run, SCHEMA)
