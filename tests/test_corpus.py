"""Worked values and edge cases of the corpus, shard, blend, tokenizer and ledger operators."""

from __future__ import annotations

import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sluicework import config
from sluicework.constants import EOS, N_MERGES, PRE_TOKEN, SPECIALS, printable_bytes
from sluicework.functions import text as T
from sluicework.operators import blend, bpe, corpus, kernels, ledger, prefix, sharding, shards
from sluicework.plans.queries import QUERIES
from sluicework.sources import files, runs, scratch
from sluicework.sources import shards as shard_files
from sluicework.streaming import ingest


def docs(spark, *texts, slug="s"):
    return spark.createDataFrame([(k, t, slug) for k, t in enumerate(texts)] or [], "doc_id long, text string, slug string")


def ids(data) -> list[int]:
    return [int.from_bytes(data[k : k + 2], "little") for k in range(0, len(data), 2)]


def test_constants():
    assert (EOS, N_MERGES, len(SPECIALS)) == (49088, 48832, 64)
    assert len(set(printable_bytes().values())) == 256 and sum(ord(c) == b for b, c in printable_bytes().items()) == 188


def test_shard_layout(spark, tmp_path):
    tokens = shards.with_index(shards.byte_documents(docs(spark, "ab", "", "c"), "slug"))
    assert [(r.doc_seq, r.seq_len, r.st * 2) for r in tokens.orderBy("doc_seq").collect()] == [(0, 3, 0), (1, 1, 6), (2, 2, 8)]
    path = str(tmp_path / "shards")
    shard_files.write_shards(tokens, path)
    shard_files.merge_parts(path, "s")
    assert open(f"{path}/s.bin", "rb").read().hex() == "61006200c0bfc0bf6300c0bf"
    assert len(open(f"{path}/s.idx", "rb").read()) == 102
    assert shard_files.read_lengths(f"{path}/s.idx").tolist() == [3, 1, 2]
    back = shard_files.read_shards(spark, path).orderBy("doc_seq").collect()
    assert [ids(r.data) for r in back] == [[97, 98, EOS], [EOS], [99, EOS]]


def test_damaged_index_is_an_error(tmp_path):
    good = shard_files.index_bytes([1, 2])
    for k, bad in enumerate([b"X" + good[1:], good[:-1], good[:9] + b"\2" + good[10:], good[:50] + b"\7" + good[51:]]):
        p = tmp_path / f"{k}.idx"
        p.write_bytes(bad)
        with pytest.raises(ValueError):
            shard_files.read_index(str(p))


def test_null_text_is_an_error(spark):
    with pytest.raises(Exception, match="null text"):
        shards.byte_documents(docs(spark, "a", None), "slug").collect()


@pytest.mark.parametrize("s,v,want", [(2, 0.4, (4, 1, 0)), (2, 0.001, (6, 2, 0)), (8, 0.001, (0, 0, 0))])
def test_split(spark, s, v, want):
    r = shards.split_bounds(shards.totals(shards.byte_documents(docs(spark, "ab", "", "c"), "slug")), s, v).first()
    assert (r.cut, r.n_train, r.n_val) == want


def test_windows_are_the_shard(spark):
    rng = random.Random(3)
    d = docs(spark, *("".join(rng.choice("abcdé") for _ in range(rng.randint(0, 30))) for _ in range(60)))
    tokens = shards.byte_documents(d, "slug")
    stream = [i for r in shards.with_index(tokens).orderBy("doc_seq").collect() for i in ids(r.data)]
    for split, frac in (("train", 0.3), ("val", 0.3)):
        b = shards.split_bounds(shards.totals(tokens), 7, frac).first()
        base, n = (0, b.n_train) if split == "train" else (b.cut, b.n_val)
        got = {r.k: (r.x, r.y) for r in shards.as_ids(shards.windows(tokens, 7, split, frac)).collect()}
        assert got == {k: (stream[base + 7 * k : base + 7 * k + 7], stream[base + 7 * k + 1 : base + 7 * k + 8]) for k in range(n)}
    span = shards.get_span(tokens, "s", 5, 40).first()
    assert ids(span.data) == stream[5:45]
    with pytest.raises(Exception, match="ends after the shard"):
        shards.get_span(tokens, "s", len(stream) - 3, 9).collect()


def test_token_budget_keeps_the_crossing_row(spark):
    t = shards.byte_documents(docs(spark, "ab", "", "c"), "slug").drop("data")
    assert [r.doc_id for r in corpus.token_budget_cut(t, ["slug"], F.lit(3)).orderBy("doc_id").collect()] == [0, 1]


def test_prefix_sums_over_many_ranges(spark):
    rows = [(g, k, (k * 7 + g) % 11) for g in (0, 1) for k in range(0, 900, 3)]
    df = spark.createDataFrame(rows, "g int, k long, v long")
    got = {(r.g, r.k): r.s for r in prefix.exclusive_sums(df, ["g"], ["k"], prefix.ranges_of(df, "k", 14), {"s": F.col("v")}).collect()}
    assert got == {(g, k): sum(v for h, j, v in rows if h == g and j < k) for g, k, _ in rows}


def test_prefix_sums_over_hashed_keys(spark):
    """Keys over the whole range of a long are dealt over the ranges like dense ones."""
    rng = random.Random(5)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), rng.randrange(9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k long, v long")
    buckets = df.select(prefix.ranges_of(df, "k", 20).alias("b")).groupBy("b").count().collect()
    assert 18 <= len(buckets) <= 21 and max(r["count"] for r in buckets) < 60
    got = {r.k: r.s for r in prefix.exclusive_sums(df, [], ["k"], prefix.ranges_of(df, "k", 20), {"s": F.col("v")}).collect()}
    assert got == {k: sum(v for j, v in rows if j < k) for k, _ in rows}
    assert sorted(r.v for r in corpus.skip_rows(df, 150, "k").collect()) == sorted(v for _, v in sorted(rows)[150:])
    assert corpus.skip_rows(df.limit(0), 3, "k").count() == 0
    one = spark.createDataFrame([(7, 1)], "k long, v long")
    assert [r.s for r in prefix.exclusive_sums(one, [], ["k"], prefix.ranges_of(one, "k"), {"s": F.col("v")}).collect()] == [0]


def blend_table(spark, rows):
    return spark.createDataFrame([(k, f"s{k}", float(w), n) for k, (w, n) in enumerate(rows)], "ds int, slug string, weight double, n_samples long")


@pytest.mark.parametrize("weights,size,want", [((0.5, 0.3, 0.2), 7, [4, 2, 1]), ((1, 1, 1), 4, [2, 1, 1]), ((0.6, 0.4, 0), 5, [3, 2, 0])])
def test_quotas(spark, weights, size, want):
    rows = blend.quotas(blend_table(spark, [(w, 100) for w in weights]), F.lit(size)).orderBy("ds").collect()
    assert [r.n for r in rows] == want


def test_schedule_and_ranks(spark):
    q = blend.quotas(blend_table(spark, [(0.5, 9), (0.3, 9), (0.2, 9)]), F.lit(7))
    rows = blend.schedule(q, width=3.0).orderBy("pos").collect()
    assert [(r.ds, r.sample) for r in rows] == [(0, 0), (1, 0), (2, 0), (0, 1), (0, 2), (1, 1), (0, 3)]
    assert blend.schedule(q, chunk=2).orderBy("pos").collect() == rows
    ranks = blend.rank_shard(blend.schedule(q), F.lit(7), 2).collect()
    assert len(ranks) == 6 and {r["rank"] for r in ranks} == {0, 1}
    assert blend.blend_size(blend_table(spark, [(0.6, 30), (0.4, 10)])).first().size == 25
    with pytest.raises(Exception, match="reduce the size"):
        blend.checked(blend.quotas(blend_table(spark, [(0.5, 1), (0.5, 9)]), F.lit(8))).collect()


def test_byte_weighted(spark):
    d = spark.createDataFrame([(k, "x" * n, g) for k, (g, n) in enumerate([("a", 100), ("a", 100), ("b", 400), ("b", 0)])], "doc_id long, text string, g string")
    t = spark.createDataFrame([("a", 0.6), ("b", 0.4)], "g string, target double")
    p = {r.g: r.p for r in corpus.byte_weighted(corpus.avg_doc_bytes(d, "g"), t, "g").collect()}
    assert p["a"] == pytest.approx(6 / 7) and p["b"] == pytest.approx(1 / 7)


def test_merges(spark):
    count = lambda *t: spark.createDataFrame([(x, 1) for x in t], "tok string, cnt long")
    assert [tuple(r) for r in bpe.pair_freq(count("aaa")).collect()] == [(97, 97, 2)]
    assert bpe.merged("aaa", "aa", 256) == chr(256) + "a" and bpe.merged("aaaa", "aa", 256) == chr(256) * 2
    assert bpe.first_merge(count("ab", "cd")).first()[:2] == (97, 98)
    assert bpe.train(count("a"), 5) == []


def plain_merges(counts, n):
    """Training by its definition: every pair is counted anew for each merge."""
    sequences, out = [(list(t.encode()), c) for t, c in counts.items()], []
    while len(out) < n:
        pairs = {}
        for ids_, c in sequences:
            for p in zip(ids_, ids_[1:]):
                pairs[p] = pairs.get(p, 0) + c
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        for ids_, _ in sequences:
            k = 0
            while k + 1 < len(ids_):
                if (ids_[k], ids_[k + 1]) == best:
                    ids_[k : k + 2] = [256 + len(out)]
                k += 1
        out.append((*best, pairs[best]))
    return out


def test_training_places_agree(spark, small):
    freq = bpe.pretoken_freq(spark.read.parquet(f"{small}/documents.parquet").limit(40)).persist()
    counts = {r.tok: r.cnt for r in freq.collect()}
    want = plain_merges(counts, 150)
    assert bpe.train(freq, 150) == want
    assert bpe.train(freq, 40, where="cluster") == want[:40]
    with pytest.raises(ValueError, match="distinct pre-tokens"):
        bpe.train(freq, 6, limit=3)


@pytest.mark.parametrize("name", ["bpe_train_k", "encode_tokens", "decode_roundtrip", "vocabulary_files", "tokenizer_report", "plan_bpe_shards"])
def test_queries_train_many_words_away_from_the_driver(spark, small, monkeypatch, name):
    """Words of more than DRIVER_BYTES never come to the driver, and nothing else changes."""
    few = sorted(map(tuple, QUERIES[name](spark, small).collect()))
    monkeypatch.setattr(bpe, "DRIVER_BYTES", 1000)
    monkeypatch.setattr(bpe, "merges_of", None)
    assert sorted(map(tuple, QUERIES[name](spark, small).collect())) == few


def test_training_where_it_fits(spark, monkeypatch):
    """Either way the merges are the same, of a very long word too."""
    counts = {"ab" * 30_000: 2, "abab": 3, "é": 1, "b": 9}
    freq = spark.createDataFrame(list(counts.items()), "tok string, cnt long")
    want = bpe.merges_of(counts, 6)
    monkeypatch.setattr(bpe, "DRIVER_BYTES", 60_007)
    assert bpe.train(freq, 6, "either") == want
    assert bpe.train(freq.limit(0), 6, "either") == []
    monkeypatch.setattr(bpe, "DRIVER_BYTES", 60_006)
    monkeypatch.setattr(bpe, "merges_of", None)
    assert bpe.train(freq, 6, "either") == want


def test_a_thousand_merges(spark, small):
    """Several merges a job, each settled by its counts, are those of one at a time."""
    counts = {r.tok: r.cnt for r in bpe.pretoken_freq(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    want = bpe.merges_of(counts, 1000)
    assert len(want) == 1000 and all(a[2] >= b[2] for a, b in zip(want, want[1:]))
    sequences, out, jobs = [(t.encode().decode("latin-1"), c) for t, c in counts.items()], [], 0
    while len(out) < 1000:  # as on the cluster, with a plain count in place of each job
        pairs, jobs = {}, jobs + 1
        for q, c in sequences:
            for p in map(str.__add__, q, q[1:]):
                pairs[p] = pairs.get(p, 0) + c
        top = sorted(pairs.items(), key=lambda x: (-x[1], x[0]))
        for pair, n in bpe.next_merges(top[:256], len(top) <= 256):
            sequences = [(bpe.merged(q, pair, 256 + len(out)), c) for q, c in sequences]
            out.append((ord(pair[0]), ord(pair[1]), n))
    assert out[:1000] == want and jobs < 1000


def test_encode_round_trip(spark, tmp_path):
    texts = ["", "a<|endoftext|>b", "two  spaces", "nbsp  x", "line\u0085  ", "IT'ſ", "naïve 12345\r\n\n  end "]
    d = docs(spark, *texts)
    merges = bpe.train(bpe.pretoken_freq(d), 20)
    files.write_vocabulary(spark, merges, str(tmp_path / "v.json"), str(tmp_path / "m.txt"))
    assert files.read_merges(spark, str(tmp_path / "v.json"), str(tmp_path / "m.txt")) == [m[:2] for m in merges]
    assert len(json.load(open(tmp_path / "v.json"))) == 256 + len(merges) + 64
    e = bpe.encode(d, merges, "doc_id")
    assert {r.doc_id: r.text for r in bpe.decode(e, merges, "doc_id").collect()} == dict(enumerate(texts))
    assert 49088 in e.where("doc_id = 1").first().ids
    assert bpe.encode(docs(spark, ""), [], "doc_id", eos=EOS).first().ids == [EOS]


def test_pretokens_match_the_regex_module(spark):
    import regex

    texts = ["two  spaces\tx", "a  b", "x\u0085y", "p q ", "IT'ſ it's WE'RE", " ...\r\n/ x 123456 ÀÉî ǅ"]
    got = {r.doc_id: r.t for r in docs(spark, *texts).select("doc_id", T.pre_tokens(F.col("text")).alias("t")).collect()}
    assert got == {k: regex.findall(PRE_TOKEN, t) for k, t in enumerate(texts)}
    assert docs(spark, "a<|im_start|>b").select(T.pre_tokens(F.col("text")).alias("t")).first().t == ["a", "b"]


def test_packed_ids(spark):
    df = spark.createDataFrame([([0, 255, 256, 49088],), ([],)], "a array<int>")
    assert [r.b for r in df.select(T.unpacked(T.packed(F.col("a"))).alias("b")).collect()] == [[0, 255, 256, 49088], []]


def test_lr_factor(spark):
    run = config.resolve({"n_steps": "20", "warmup_steps": 2})
    f = [r.factor for r in ledger.lr_schedule(spark, run).orderBy("step").collect()]
    assert f == [0.0, 0.5] + [1.0] * 17 + [0.5]
    with pytest.raises(KeyError):
        config.resolve({"n_step": 1})


def test_parameters(spark):
    from sluicework.plans.oracles import run_table

    n = {r.run: r.n_params for r in ledger.parameters(config.table(spark, *run_table())).collect()}
    assert (n["run_246m"], n["run_480m"], n["run_124m"]) == (246_191_104, 479_786_240, 113_265_408)


def test_config_files(tmp_path):
    p = tmp_path / "p.yaml"
    p.write_text("shards:\n  - {repo_id: a/b, category: web, tokens: 44e9}\n  - {repo_id: a/c, category: code, tokens: 5}\n")
    assert [s.tokens for s in config.load_plan(p)] == [44_000_000_000, 5]
    assert [s.repo_id for s in config.load_plan(p, category="code", repo_id="a/c")] == ["a/c"]
    with pytest.raises(KeyError, match="there are"):
        config.load_mix("none")


def test_blobs(spark, tmp_path):
    (tmp_path / "content").mkdir()
    (tmp_path / "content/x").write_bytes(gzip.compress("grüß".encode("latin-1")))
    (tmp_path / "content/y").write_bytes(b"not gzip")
    rows = spark.createDataFrame([("x", "latin-1"), ("y", None), ("z", "utf-8")], "blob_id string, src_encoding string")
    got = {r.blob_id: (r.text, r.fetched) for r in files.with_blobs(rows, files.read_blobs(spark, str(tmp_path))).collect()}
    assert got == {"x": ("grüß", True), "y": ("", False), "z": ("", False)}
    fetched = files.fetch_blobs(rows, lambda: str(tmp_path), lambda c, k: open(f"{c}/{k}", "rb").read())
    assert {r.blob_id: r.text for r in fetched.collect()} == {"x": "grüß", "y": "", "z": ""}


def test_pinned_files_must_not_change(spark, tmp_path):
    path = str(tmp_path / "t")
    docs(spark, "a", "b").coalesce(1).write.parquet(path)
    pins = spark.createDataFrame(files.pinned_files(spark.read.parquet(path)).collect())
    docs(spark, "later").coalesce(1).write.mode("append").parquet(path)
    assert sorted(r.text for r in files.read_pinned(spark, pins).collect()) == ["a", "b"]
    old = pins.withColumn("bytes", F.col("bytes") + 1)
    with pytest.raises(ValueError, match="pinned"):
        files.read_pinned(spark, old)


def test_reads_by_pointer(spark, tmp_path):
    rng = random.Random(6)
    d = docs(spark, *("".join(rng.choice("abé") for _ in range(rng.randint(0, 20))) for _ in range(80)))
    tokens = shards.with_index(shards.byte_documents(d, "slug"))
    path = str(tmp_path / "s")
    ordered = tokens.repartitionByRange(3, "slug", "doc_seq").sortWithinPartitions("slug", "doc_seq")
    spark.dataSource.register(shard_files.TokenShards)
    ordered.select("slug", "doc_seq", "data").write.format("tokenshard").mode("append").save(path)
    want = [bytes(r.data) for r in tokens.orderBy("doc_seq").collect()]
    stream = b"".join(want)
    ask = spark.createDataFrame([("s", k) for k in (0, 79, 40, 40)], "slug string, doc_seq long")
    spans = spark.createDataFrame([("s", 3, 300), ("s", 0, len(stream) // 2), ("s", 5, 0)], "slug string, start long, length long")
    for merge in (False, True):
        if merge:
            shard_files.merge_all(spark, path)
        pairs = shard_files.index_lengths(spark, path).collect()
        assert len(pairs) == (1 if merge else 3) and sum(r.n_docs for r in pairs) == 80 and sum(r.n_tokens for r in pairs) == len(stream) // 2
        assert [(r.doc_seq, bytes(r.data)) for r in shard_files.documents_at(ask, path).collect()] == [(k, want[k]) for k in (0, 79, 40, 40)]
        assert [bytes(r.data) for r in shard_files.spans_at(spans, path).collect()] == [stream[6:606], stream, b""]
    with pytest.raises(Exception, match="ends after the shard"):
        shard_files.spans_at(spans.selectExpr("slug", "start", "length + 100000 as length"), path).collect()
    with pytest.raises(Exception, match="has 80 documents"):
        shard_files.documents_at(ask.selectExpr("slug", "doc_seq + 80 as doc_seq"), path).collect()


def test_plan_to_shards(spark, tmp_path):
    """What is left out before encoding would have been cut after it."""
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(["the", "then", "é", "<|endoftext|>"]) for _ in range(rng.randint(0, 9))), rng.choice("ab")) for k in range(120)] + [(500, None, "a"), (501, "x", "c")]
    d = spark.createDataFrame([(s, k, t) for k, t, s in rows], "slug string, doc_id long, text string")
    merges = sharding.learn(d, 12)
    budgets = spark.createDataFrame([("a", 60), ("b", 10**9), ("none", 5)], "slug string, budget long")
    got = sharding.write_plan(d, budgets, merges, str(tmp_path / "p")).collect()
    tok = bpe.tokenizer(tuple(m[:2] for m in merges))
    want = {}
    for slug, budget in (("a", 60), ("b", 10**9)):
        used, want[slug] = 0, []
        for _, t, s in sorted(rows):
            if s == slug and t is not None and used <= budget:
                want[slug].append([*tok.encode(t, add_special_tokens=False).ids, EOS])
                used += len(want[slug][-1])
    assert {s: [ids(r.data) for r in sorted(got, key=lambda r: r.doc_seq) if r.slug == s] for s in ("a", "b")} == want
    assert len(got) == sum(map(len, want.values())) and len(want["a"]) < 60
    early = sharding.may_be_kept(d.where("text is not null"), budgets, bpe.longest(merges))
    assert len(want["a"]) <= early.where("slug = 'a'").count() < d.where("slug = 'a'").count()
    assert sharding.plan_tokens(d.limit(0), budgets, merges).count() == 0


def test_run_ledger(spark, tmp_path):
    folder, run = str(tmp_path / "c"), config.load_run("smoke")
    for k in (10, 20, 20):
        runs.commit(spark, folder, run, k, 4 * k, k)
    assert runs.resume(spark, folder, run) == (20, 80, 20) and runs.resume(spark, folder, run, 10) == (10, 40, 10)
    assert runs.entries(spark, folder).count() == 2 and not list((tmp_path / "c").glob("*.tmp"))
    assert runs.resume(spark, folder, config.resolve({**config.RUNS["smoke"], "device": "cpu"}))[0] == 20
    with pytest.raises(ValueError, match="lr"):
        runs.resume(spark, folder, config.resolve({**config.RUNS["smoke"], "lr": 1.0}))
    with pytest.raises(FileNotFoundError):
        runs.resume(spark, folder, run, 11)
    (tmp_path / "w").mkdir()
    (tmp_path / "w/checkpoint-1.json").write_text('{"config": {}}')
    with pytest.raises(ValueError, match="weights only"):
        runs.resume(spark, str(tmp_path / "w"), run)


def test_commands(spark, tmp_path):
    from sluicework.__main__ import run

    for slug, n in (("fineweb-edu-sample-100BT", 30), ("dclm-baseline-1.0", 20)):
        docs(spark, *(f"some words {k} and more" for k in range(n))).select("text").write.parquet(str(tmp_path / "d" / slug))
    names = ["--data", str(tmp_path / "d"), "--vocab", str(tmp_path / "v.json"), "--merge-file", str(tmp_path / "m.txt")]
    one = [*names[:1], str(tmp_path / "d/dclm-baseline-1.0"), *names[2:]]
    assert run(spark, ["train-tokenizer", "--merges", "9", *one]).first().n_merges == 9
    report = {r.slug: r for r in run(spark, ["metrics", "--sample-size", "5", *names]).collect()}
    assert set(report) == {"fineweb-edu-sample-100BT", "dclm-baseline-1.0"} and all(r.bytes_per_token > 1 for r in report.values())
    written = run(spark, ["shards", "-r", "mlfoundations/dclm-baseline-1.0", "--out", str(tmp_path / "o"), *names]).collect()
    assert [(r.slug, r.n_docs) for r in written] == [("dclm-baseline-1.0", 20)]
    with pytest.raises(ValueError, match="no such source"):
        run(spark, ["shards", "-r", "x", "--out", str(tmp_path / "o"), *names])
    spark.createDataFrame([("a", 0, 10.8), ("a", 9, 0.01)], "run string, step long, loss double").write.parquet(str(tmp_path / "l"))
    assert run(spark, ["gate", "step0", "--losses", str(tmp_path / "l")]).first().passed and run(spark, ["gate", "overfit", "--losses", str(tmp_path / "l")]).first().passed
    runs.commit(spark, str(tmp_path / "k"), config.load_run("smoke"), 5, 6, 7)
    assert tuple(run(spark, ["resume", "--folder", str(tmp_path / "k")]).first()) == (5, 6, 7)


def test_kept_schedules(spark, tmp_path):
    sources = blend_table(spark, [(0.5, 9), (0.5, 9)])
    first = blend.cached(sources, 6, 4, "train", str(tmp_path)).orderBy("pos").collect()
    (kept,) = tmp_path.glob("blend-*")
    at = (kept / "_SUCCESS").stat().st_mtime_ns
    assert blend.cached(sources, 6, 4, "train", str(tmp_path)).orderBy("pos").collect() == first and (kept / "_SUCCESS").stat().st_mtime_ns == at
    (kept / "_SUCCESS").unlink()  # not written to its end
    assert blend.cached(sources, 6, 4, "train", str(tmp_path)).orderBy("pos").collect() == first and (kept / "_SUCCESS").exists()
    blend.cached(sources, 5, 4, "train", str(tmp_path)).count()
    assert len(list(tmp_path.glob("blend-*"))) == 2


def test_transformer_block(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    d, heads, kv, hd, ff, n = 8, 4, 2, 2, 6, 5
    shapes = {"wq": (heads * hd, d), "wk": (kv * hd, d), "wv": (kv * hd, d), "wo": (d, heads * hd), "gate": (ff, d), "up": (ff, d), "down": (d, ff)}
    w = {k: rng.normal(size=v) for k, v in shapes.items()} | {"norm1": rng.normal(size=d), "norm2": rng.normal(size=d)}
    x = rng.normal(size=(n, d))
    norm = lambda v, g: v / np.sqrt((v * v).mean(-1, keepdims=True) + 1e-6) * g

    def rotated(v):  # (n, heads, hd)
        angle = np.arange(n)[:, None, None] / 10000.0 ** (2 * np.arange(hd // 2) / hd)
        a, b = v[..., : hd // 2], v[..., hd // 2 :]
        return np.concatenate([a * np.cos(angle) - b * np.sin(angle), b * np.cos(angle) + a * np.sin(angle)], -1)

    h = norm(x, w["norm1"])
    q, k, v = rotated((h @ w["wq"].T).reshape(n, heads, hd)), rotated((h @ w["wk"].T).reshape(n, kv, hd)), (h @ w["wv"].T).reshape(n, kv, hd)
    out = np.zeros((n, heads, hd))
    for p in range(n):
        for i in range(heads):
            e = np.exp(k[: p + 1, i // 2] @ q[p, i] * hd**-0.5)
            out[p, i] = (e / e.sum()) @ v[: p + 1, i // 2]
    y = x + out.reshape(n, -1) @ w["wo"].T
    g = norm(y, w["norm2"])
    z = g @ w["gate"].T
    want = y + (z / (1 + np.exp(-z)) * (g @ w["up"].T)) @ w["down"].T
    rows = spark.createDataFrame([(0, p, x[p].tolist()) for p in range(n)], "seq int, pos int, x array<double>")
    weights = spark.createDataFrame([tuple(a.tolist() for a in w.values())], ", ".join(f"{k} array<{'double' if a.ndim == 1 else 'array<double>'}>" for k, a in w.items()))
    got = kernels.block(rows, weights, heads, kv, hd).orderBy("pos").collect()
    assert np.allclose([r.x for r in got], want)


def test_corpus_files(spark, tmp_path):
    files.write_corpus(docs(spark, "a\nb", "é"), str(tmp_path / "c"))
    assert sorted(r.text for r in files.read_corpus(spark, str(tmp_path / "c")).collect()) == ["a\nb", "é"]


def test_stream_resumes_within_the_budget(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    schema = docs(spark, "x").schema
    for k in range(3):
        spark.createDataFrame([(10 * k + j, "abcd", "s") for j in range(4)], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = ingest.document_stream(spark, str(source), schema, files_per_batch=1)
        ingest.ingest(stream, lambda b: shards.byte_documents(b, "slug"), str(out), budget=32)
    total = ingest.ledger(spark, str(out)).groupBy("slug").agg(F.sum("n_docs").alias("n"), F.sum("n_tokens").alias("t")).first()
    assert (total.n, total.t) == (7, 35)  # the row that crosses 32 is kept, later ones aren't
    assert spark.read.parquet(str(out / "tokens")).count() == 7


def test_progress_of_a_stream(spark, tmp_path):
    schema, told = docs(spark, "x").schema, []
    for k in range(3):
        spark.createDataFrame([(10 * k + j, "abcd", "s") for j in range(4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.document_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    ingest.ingest(stream, lambda b: shards.byte_documents(b, "slug"), str(tmp_path / "out"), budget=1000, say=lambda batch, n: told.append((batch, n)), every=5)
    assert told == [(1, 8), (2, 12)]


def test_attention_and_feed_forward(spark):
    import math

    rows = spark.createDataFrame([(0, 0, p, [1.0, float(p)], [float(p), 1.0], [float(p), 2.0]) for p in range(3)], "seq int, head int, pos int, q array<double>, k array<double>, v array<double>")
    out = {r.pos: r.out for r in kernels.causal_attention(rows, 0.5).collect()}
    w = [math.exp(0.5 * (j + 2)) for j in range(3)]
    assert out[0] == pytest.approx([0, 2]) and out[2] == pytest.approx([(w[1] + 2 * w[2]) / sum(w), 2])
    m = F.lit(1.0)
    eye = F.array(F.array(m, F.lit(0.0)), F.array(F.lit(0.0), m))
    y = spark.range(1).select(kernels.swiglu(F.array(F.lit(1.0), F.lit(2.0)), eye, eye, eye).alias("y")).first().y
    assert y == pytest.approx([1 / (1 + math.exp(-1)), 4 / (1 + math.exp(-2))])
    heads = spark.createDataFrame([(h,) for h in range(4)], "head int")
    assert [r.kv_head for r in kernels.grouped_heads(heads, 4, 2).orderBy("head").collect()] == [0, 0, 1, 1]


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    tokens = shards.byte_documents(none, "slug")
    assert shards.windows(tokens, 4, "train", 0.1).count() == 0
    assert bpe.train(bpe.pretoken_freq(none), 3) == []
    assert corpus.byte_cut(none, 10, ["doc_id"], F.floor(F.col("doc_id") / 8)).count() == 0


def _scattered(spark, folder, n: int) -> str:
    """A table of ``n`` documents in as many files, the last documents in the oldest ones."""
    rows = [(k, "x" * 999, f"s{k % 2}") for k in range(n)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    d.repartitionByRange(n, F.desc("doc_id")).write.parquet(f"{folder}/documents.parquet")
    files_ = sorted((folder / "documents.parquet").glob("part-*"))
    assert len(files_) > 64
    for k, f in enumerate(files_):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder)


def test_stream_of_a_table_in_many_files(spark, tmp_path):
    """A folder is read like a file, and the cut goes by documents whatever file they are in."""
    folder = _scattered(spark, tmp_path, 90)
    got = QUERIES["streaming_token_budget"](spark, folder).orderBy("slug").collect()
    assert [tuple(r) for r in got] == [("s0", 21, 21_000), ("s1", 21, 21_000)]
    files_ = ingest.document_stream(spark, f"{folder}/[d]ocuments.parquet", "doc_id long, text string, source string", "*", None)
    ingest.ingest(files_, lambda b: shards.byte_documents(b, "source"), str(tmp_path / "out"), 20_000)
    kept = [r.doc_id for r in spark.read.parquet(str(tmp_path / "out/tokens")).collect()]
    assert sorted(kept) == list(range(42))


def test_restarts_write_in_parallel(spark, tmp_path, monkeypatch):
    """No task writes a whole third; the cut is that of one file for each."""
    folder = _scattered(spark, tmp_path, 90)
    monkeypatch.setattr(scratch, "fresh_path", lambda s, label: f"{tmp_path}/{label}")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # two files a task
    try:
        got = QUERIES["streaming_restarts"](spark, folder).orderBy("slug").collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert [tuple(r) for r in got] == [("s0", 21, 21_000), ("s1", 21, 21_000)]
    assert len(list((tmp_path / "ingest/in").glob("part-*"))) > 3


def test_interleaving_deals_no_source_to_one_task(spark, small):
    """Sources' shares are broadcast whatever their estimated size, and texts that nobody asks for aren't shuffled."""
    docs_ = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", "text")
    shares = spark.createDataFrame([(0, "en", 0.6), (1, "fr", 0.4)], "ord int, lang string, p double")
    found = corpus.tokenizer_corpus(docs_, shares, "lang", 100_000)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin [lang" in plan(found)
        sorts = [line for line in plan(found.select("doc_id", "j", "before")).split("\n") if "Window [" in line or "SortMergeJoin" in line]
        assert sorts and not any("text#" in line for line in sorts)
        short = plan(found.select("doc_id", "j", "before"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all("text#" not in line for line in short.split("\n") if "Project [" in line and "octet_length" not in line)
    assert [r.text for r in found.orderBy("t", "ord", "j").limit(3).collect()] and found.where("text is null or text = ''").count() == 0
