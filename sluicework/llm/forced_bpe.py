"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be merged
over: between such bytes every encoding has a boundary, whatever stands around them. A text is
cut at these places, each fragment is encoded alone (and remembered), and the ids are joined.

Two tiers of cuts are used. Before a space that follows another character the cut also holds for
the pre-tokenizer, which never looks across that place, so it is made on the raw text; that no
token has a space after another byte is checked against the vocabulary's own pair table. The
remaining cuts are made inside the pre-tokens, by the table. Merging is done here, lowest rank
first and leftmost first; the tokenizers library is not called.

Edge cases: null and empty texts have no ids (the digest of the empty string); special tokens in
a text keep their own id, as the library's default has it; very long fragments without a cut are
merged with a heap in n log n steps; repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import claim, documents_of
from .vocabulary import BLANKS, KEPT, MARKS, PIECE, Irregular

#: The pre-tokenizer of byte-level vocabularies.
PRE_TOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Fragments above this length are merged with a heap.
LONG = 48


def printable_alphabet() -> dict[str, int]:
    """Character that a vocabulary file shows for each byte, and that byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    return shown | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class ForcedBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, vocab = printable_alphabet(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.id_of_byte = [0] * 256
        for i, token in self.bytes_of.items():
            if len(token) == 1:
                self.id_of_byte[token[0]] = i
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.bytes_of |= {i: s.encode() for s, i in self.specials.items()}
        self.joined = np.zeros((256, 256), bool)  # pairs that some token holds
        for token in self.bytes_of.values():
            self.joined[list(token[:-1]), list(token[1:])] = True
        ends = {c.encode()[-1] for c in BLANKS}  # a space after white space is no such cut
        self.cuts_at_space = not self.joined[[b for b in range(256) if b not in ends], 32].any()
        self.never = [frozenset(np.flatnonzero(~row).tolist()) for row in self.joined]
        self.spaced, self.bare = _Memo(self, " "), _Memo(self, "")
        self.get_any = lambda p: self.get_spaced(p[1:]) if p[0] == " " and p[1:] and p[1] not in BLANKS else self.get_bare(p) if p[0] not in BLANKS else np.asarray(self.encode_piece(p), "<u4").tobytes()
        self.get_spaced, self.get_bare = self.spaced.__getitem__, self.bare.__getitem__
        self.newline = np.asarray(self.encode_piece("\n"), "<u4").tobytes()
        places = range(max(self.bytes_of) + 1)  # by number, for whole documents
        self.bytes_at, self.digits_at = [self.bytes_of.get(i) for i in places], [b"%d" % i for i in places]

    def fragments(self, token: bytes) -> list[bytes]:
        """A pre-token cut at every pair of bytes that no token holds."""
        never, start, out = self.never, 0, []
        for k in range(1, len(token)):
            if token[k] in never[token[k - 1]]:
                out.append(token[start:k])
                start = k
        out.append(token[start:])
        return out

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the pair of lowest rank is merged, the leftmost first, until none is left."""
        ids = [self.id_of_byte[b] for b in fragment]
        if len(ids) > LONG:
            return self._merge_long(ids)
        get, none = self.rank.get, len(self.made)
        while len(ids) > 1:
            ranks = [get(p, none) for p in zip(ids, ids[1:])]
            if (low := min(ranks)) == none:
                break
            k = ranks.index(low)
            ids[k : k + 2] = [self.made[low]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        left, right, gone = list(range(-1, n - 1)), list(range(1, n + 1)), bytearray(n)
        get = self.rank.get
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            nxt = right[k]
            if gone[k] or ids[k] != a or nxt >= n or ids[nxt] != b:
                continue  # one of the two has been merged since
            ids[k], gone[nxt], right[k] = self.made[r], 1, right[nxt]
            if right[k] < n:
                left[right[k]] = k
                if (x := get((ids[k], ids[right[k]]))) is not None:
                    heapq.heappush(heap, (x, k, ids[k], ids[right[k]]))
            if left[k] >= 0 and (x := get((ids[left[k]], ids[k]))) is not None:
                heapq.heappush(heap, (x, left[k], ids[left[k]], ids[k]))
        return [i for k, i in enumerate(ids) if not gone[k]]

    def encode_piece(self, piece: str) -> list[int]:
        return list(chain.from_iterable(self.merge(f) for token in PRE_TOKEN.findall(piece) for f in self.fragments(token.encode())))

    def _line(self, text: str) -> bytes:
        """Ids of what stands between two line breaks, with white space at neither end."""
        head, *words = text.split(" ")
        return self.get_bare(head) + b"".join(map(self.get_spaced, words))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, as 32-bit numbers."""
        if not text:
            return np.empty(0, "<u4")
        if self.special and self.special.search(text):
            return np.concatenate([np.asarray([self.specials[x]], "<u4") if x in self.specials else self.encode(x) for x in self.special.split(text)])
        if self.cuts_at_space:
            lines = text.split("\n") if "\n\n" not in text else [text]
            if all(lines) and not any(x[0] in BLANKS or x[-1] in BLANKS for x in lines):
                with suppress(Irregular):
                    return np.frombuffer(self.newline.join(map(self._line, lines)), "<u4")
        return np.frombuffer(b"".join(map(self.get_any, PIECE.findall(text))), "<u4")

    def decode(self, ids) -> str:
        """Text of the ids, special tokens kept; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class _Memo(dict):
    """Ids of the pieces seen so far, without their leading space."""

    def __init__(self, bpe: ForcedBpe, prefix: str):
        self.bpe, self.prefix = bpe, prefix

    def __missing__(self, word: str) -> bytes:
        if not word or word[-1] in BLANKS or (self.prefix and word[0] in BLANKS):
            raise Irregular
        core = word.rstrip(MARKS)
        if len(core) < len(word) and core.isalpha():  # the marks that end a word of letters are a pre-token of their own
            ids = self[core] + self.bpe.bare[word[len(core) :]]
        else:
            ids = np.asarray(self.bpe.encode_piece(self.prefix + word), "<u4").tobytes()
        if len(self) < KEPT and len(word) < 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def forced_bpe(path: str) -> ForcedBpe:
    return ForcedBpe(path)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("forced", forced_bpe.cache_clear)
        bpe = forced_bpe(tokenizer_path)
        for batch in batches:
            ids = [bpe.encode(t).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) of ``encode``'s rows; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("forced", forced_bpe.cache_clear)
        bpe = forced_bpe(tokenizer_path)
        for batch in batches:
            text = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document the number of ids and SHA-256 of the ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("forced", forced_bpe.cache_clear)
        bpe = forced_bpe(tokenizer_path)
        digits, bytes_ = bpe.digits_at.__getitem__, bpe.bytes_at.__getitem__
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py()).tolist()
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(b",".join(map(digits, ids))).hexdigest())
                of_text.append(hashlib.sha256(b"".join(map(bytes_, ids)).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents_of(docs).mapInArrow(run, SCHEMA)
