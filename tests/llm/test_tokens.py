"""Encoders against the tokenizers library, exact round trips of the store, and packing's promises."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluicework.llm import chunk_store, forced_bpe, ss_packing, vocabulary
from sluicework.llm.queries import BYTE_BPE, op4_content_addressed_ids, op5_forced_boundary_bpe, op10_sum_of_squares_packing

PATH = vocabulary.public_path(BYTE_BPE)
ODD = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a\n b", "a \n b", "\t x", "x\r\ny", "don't we'll 'S '", "it's'", "a b", "a  b", "  q", "　漢字 かな", "naïve ÀÉ ß́",
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c", "<|end", "123 4567 ²½", "!!! ... ?!,", "x" * 30_000, " " * 5_000, "ab" * 20_000, "\U0001f600\U0001f468‍\U0001f469", "\x00\x1f\x85\x7f", "é ﻿", "_a_b-c.d/e", "퟿",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts(spark, n=150) -> list[str | None]:
    rng = random.Random(2)
    pool = ["a", "B", "é", " ", "  ", "\n", "'s", "'", "1", ".", "!", "\t", "ß", "漢", " ", "th", "ing", "<|endoftext|>", "​", "-"]
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return ODD + made + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(n).collect()]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", b"") for r in rows], "doc_id long, text string, part int, address string, ids binary")


def words(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def test_both_encoders_are_the_library(spark, library):
    forced, pieces = forced_bpe.forced_bpe(PATH), vocabulary.piece_encoder(PATH)
    for t in texts(spark):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert forced.encode(t).tolist() == want, repr(t)[:80]
        assert words(pieces.encode(t)) == want, repr(t)[:80]
        assert forced.decode(want) == library.decode(want, skip_special_tokens=False) == (t or "")


def test_forced_cuts_are_never_inside_a_token():
    bpe = forced_bpe.forced_bpe(PATH)
    pairs = {p for t in bpe.bytes_of.values() for p in zip(t, t[1:])}
    rng = random.Random(9)
    for _ in range(300):
        token = bytes(rng.randrange(256) for _ in range(rng.randint(1, 40)))
        parts = bpe.fragments(token)
        assert b"".join(parts) == token
        ends = np.cumsum([len(p) for p in parts])[:-1].tolist()
        assert ends == [k for k in range(1, len(token)) if (token[k - 1], token[k]) not in pairs]
    for n in (5, 60, 500):  # either way of merging gives the same
        fragment = bytes(rng.choice(b"theing and") for _ in range(n))
        ids = [bpe.id_of_byte[b] for b in fragment]
        low = list(ids)
        while True:
            ranks = [bpe.rank.get(p, 1 << 40) for p in zip(low, low[1:])]
            if not ranks or min(ranks) == 1 << 40:
                break
            k = ranks.index(min(ranks))
            low[k : k + 2] = [bpe.made[ranks[k]]]
        assert bpe._merge_long(ids) == low == bpe.merge(fragment)


def test_digests(spark, library):
    rows = list(enumerate(texts(spark, 20))) + [(3, "again"), (None, "no id")]
    got = sorted(map(tuple, forced_bpe.digests(table(spark, rows), PATH).collect()), key=repr)
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = forced_bpe.decode(forced_bpe.encode(table(spark, rows), PATH), PATH)
    assert sorted((r.text for r in back.collect())) == sorted(t or "" for _, t in rows)
    assert forced_bpe.digests(table(spark, rows).limit(0), PATH).count() == 0


def test_whole_table_digests(spark, small, library):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op5_forced_boundary_bpe(spark, small).collect()
    assert {r.doc_id for r in rows} == set(text)
    for r in rows:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())


def stream(library, rows, end):
    return [(k, library.encode(t or "", add_special_tokens=False).ids + [end]) for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]


def test_store_of_whole_table(spark, small, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    at, want = 0, []
    for k, ids in stream(library, rows, 2):
        want.append((k, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in op4_content_addressed_ids(spark, small).orderBy("doc_id").collect()] == want


def test_store_round_trip_and_damage(spark, library, tmp_path):
    long = " ".join(random.Random(1).choice(["the", "river", "and", "stone", "went"]) for _ in range(40_000))
    rows = list(enumerate(texts(spark, 10))) + [(900, long), (901, long), (902, "before " + long), (7, "same id"), (None, None)]
    path = str(tmp_path / "store")
    chunk_store.write_store(table(spark, rows), path, PATH, end_id=2)
    got = chunk_store.read_documents(spark, path).orderBy("start").collect()
    want = stream(library, rows, 2)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=key) == sorted(want, key=key)
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) for r in got)])[:-1].tolist()
    assert [r.doc_id for r in got] == [k for k, _ in want]
    checked = chunk_store.verify(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in checked] == [(r.doc_id, r.start, len(r.ids), zlib.crc32(np.asarray(r.ids, "<u4").tobytes())) for r in got]
    objects = spark.read.parquet(f"{path}/objects").where("address is not null")
    assert objects.count() == objects.select("address").distinct().count()  # each chunk once
    assert objects.agg(F.sum("n_ids")).first()[0] < 0.6 * sum(len(i) for _, i in want)  # and shared by the three long texts
    # a chunk that isn't what its address says, and one that is gone
    for k, change in enumerate(({"ids": F.concat("ids", F.lit(b"\0\0"))}, None)):
        bad = str(tmp_path / f"bad{k}")
        chunks, rest = spark.read.parquet(f"{path}/objects").where("address is not null"), spark.read.parquet(f"{path}/objects").where("address is null")
        one = chunks.agg(F.min("address")).first()[0]
        hit = F.col("address") == F.lit(one)
        damaged = chunks.withColumn("ids", F.when(hit, change["ids"]).otherwise(F.col("ids"))) if change else chunks.where(~hit)
        damaged.unionByName(rest).write.parquet(f"{bad}/objects")
        for t in ("manifest", "parts"):
            spark.read.parquet(f"{path}/{t}").write.parquet(f"{bad}/{t}")
        with pytest.raises(Exception, match="damaged" if change else "missing"):
            chunk_store.verify(spark, bad).collect()
    chunk_store.write_store(table(spark, rows).limit(0), str(tmp_path / "none"), PATH, end_id=2)
    assert chunk_store.verify(spark, str(tmp_path / "none")).count() == 0


def test_cuts_follow_the_content():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50_000, 60_000)
    cuts = chunk_store.cut_points(ids)
    lengths = np.diff([0, *cuts])
    assert cuts[-1] == len(ids) and lengths[:-1].min() >= chunk_store.LEAST and lengths.max() <= chunk_store.MOST
    shifted = chunk_store.cut_points(np.concatenate([rng.integers(0, 50_000, 777), ids]))
    assert len({c - 777 for c in shifted} & set(cuts)) > 0.8 * len(cuts)
    # documents laid end to end are cut as each alone is
    parts = [ids[:1], ids[:64], ids[1000:20_000], np.zeros(9000, np.int64), ids[5:3000]]
    ends = np.cumsum([len(p) for p in parts])
    alone = [int(e - len(p)) + c for p, e in zip(parts, ends) for c in chunk_store.cut_points(p)]
    assert chunk_store.cut_points(np.concatenate(parts), ends) == alone
    assert chunk_store.cut_points(np.zeros(10_000, np.int64))[-1] == 10_000 and chunk_store.cut_points(ids[:0]) == []


def test_joined_checksums_and_roots():
    rng = random.Random(8)
    documents = [[rng.randbytes(4 * rng.choice([1, 2, 64, 700, 4096])) for _ in range(rng.choice([1, 2, 3, 9, 40]))] for _ in range(30)]
    ends = np.cumsum([len(d) for d in documents])
    chunks = [c for d in documents for c in d]
    got = chunk_store.joined_crc32(np.asarray([zlib.crc32(c) for c in chunks]), np.asarray([len(c) // 4 for c in chunks]), ends)
    assert got.tolist() == [zlib.crc32(b"".join(d)) for d in documents]
    assert chunk_store.joined_crc32(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)).tolist() == []
    h = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    a, b, c = (h(b"\0" + x) for x in (b"a", b"b", b"c"))
    assert chunk_store.merkle_root([b"a", b"b", b"c"]) == h(b"\1" + h(b"\1" + a + b) + c)


def check_packing(rows, want, capacity):
    """Every id in exactly one piece, sequences gapless; returns the padding."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == {k for k, _ in want}
    for k, ids in want:
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing_whole_table(spark, small, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert check_packing(op10_sum_of_squares_packing(spark, small).collect(), stream(library, rows, 1), 2048) == 0


def test_packing_edges(spark, library):
    rows = list(enumerate(texts(spark, 30))) + [(5000, "word " * 9000)]
    got = ss_packing.pack(table(spark, rows), PATH, capacity=128).collect()
    assert check_packing(got, stream(library, rows, 1), 128) == 0
    assert ss_packing.pack(table(spark, rows).limit(0), PATH).count() == 0
    twice = ss_packing.pack(table(spark, [(None, "a b c"), (None, "a b c")]), PATH).collect()
    assert sum(r.length for r in twice) == 2 * (len(library.encode("a b c").ids) + 1)


def test_packing_of_a_very_long_text_among_many_splits(spark, library):
    rng = random.Random(13)
    words = ["stone", "river", "und", "l'eau", "the", "12,5", "\u6f22"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 9, 300])))) for k in range(200)]
    rows += [(900, " ".join(rng.choice(words) for _ in range(250_000))), (901, None), (902, "")]
    got = ss_packing.pack(table(spark, rows).repartition(9), PATH).collect()
    assert check_packing(got, stream(library, rows, 1), 2048) == 0
    assert len({r.sequence_id // ss_packing.PER_TASK for r in got}) > 4


def test_rule_takes_the_least_sum_of_squares():
    rng = random.Random(12)
    c, rule = 40, ss_packing.SumOfSquares(40)
    for _ in range(3000):
        size, levels = rng.randint(1, c - 1), rule.levels.copy()

        def after(h):
            n = levels.copy()
            if h:
                n[h] -= 1
            if h + size < c:
                n[h + size] += 1
            return int((n[1:c] ** 2).sum())

        options = [h for h in range(c - size + 1) if h == 0 or levels[h]]
        best = rule.place(size)
        assert best in options and after(best) == min(map(after, options))
        n = levels.copy()
        if best:
            n[best] -= 1
        if best + size < c:
            n[best + size] += 1
        assert (n[1:c] == rule.levels[1:c]).all()
