"""License spans, nearest neighbours and near duplicates against brute force."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pytest

from sluicework.llm import components, license_scan, minmax_dedup, oracles, prefix_forest
from sluicework.llm.queries import op2_winnowed_license_scan, op3_hash_prefix_forest, op7_minmax_near_duplicates


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 0.5, 2) for r in rows], "doc_id long, text string, node int, digest string, component double, bit int")


# near duplicates


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def brute_groups(rows, size, percent):
    """{doc_id: (n_shingles, component)} of rows with distinct ids."""
    sets = {k: shingles(t, size) for k, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def variants(rng, n):
    """Families of near copies on both sides of the limit, chains, exact copies and short texts."""
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = []
    while len(out) < n:
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 4, 5, 12, 40, 120, 400]))]
        for _ in range(rng.randint(1, 6)):
            out.append(" ".join(base))
            base = [rng.choice(vocab) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]  # each from the last: chains
    return out[:n]


@pytest.mark.parametrize("size", [4, 5])
def test_groups_are_those_of_all_pairs(spark, size):
    rng = random.Random(size)
    texts = variants(rng, 300) + [None, "", " \n\t", "Same Words HERE", "same words here", "one", "ONE", "É x y z", "é x y z"]
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    got = {r.doc_id: r for r in minmax_dedup.near_duplicates(table(spark, rows), size, 80).collect()}
    want = brute_groups(rows, size, 80)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert len({c for _, c in want.values()}) < len(rows) - 50  # there was something to find


def test_large_group_of_near_copies(spark):
    """Every two copies of a group differ; some classes meet only through others."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(300)}" for _ in range(150)]
    rows = []
    for k in range(700):
        words = list(base)
        words[rng.randrange(150)] = f"x{k}"
        if k % 7 == 0:
            words[rng.randrange(150)] = f"y{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"z{rng.randrange(50)}" for _ in range(30))) for k in range(100)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax_dedup.near_duplicates(table(spark, rows), 4, 80).collect()}
    assert got == brute_groups(rows, 4, 80)


def test_half_similar_documents_are_compared_within_buckets(spark):
    """Documents on one template, none linked: nothing is found, and what is compared follows the buckets."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(90)]
    rows = [(k, " ".join(base + [f"x{rng.randrange(10**6)}" for _ in range(30)])) for k in range(400)]
    rows += [(k + 1000, t + " end") for k, t in rows[:50]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax_dedup.near_duplicates(table(spark, rows), 4, 80).collect()}
    assert got == brute_groups(rows, 4, 80)

    def planned(n, size):  # a long chain: each bucket shares a class with the next one
        rows = [(k, k * (size - 1) + j, 50, k * (size - 1) + j, 0) for k in range(n) for j in range(size)]
        return minmax_dedup.comparisons(spark.createDataFrame(rows, "bucket long, node long, n long, c long, cluster long")).groupBy("kind").sum("pairs").collect()

    (small,), (large,) = planned(200, 8), planned(800, 8)
    assert small.kind == large.kind == 1 and small[1] == 200 * 8 * 7 and large[1] == 4 * small[1]
    # buckets that hold nearly the same classes are compared once, over their cluster
    rows = [(b, k, 50, 0 if k < 500 else k, 0) for b in range(40) for k in range(600) if (k + b) % 5]
    (whole,) = minmax_dedup.comparisons(spark.createDataFrame(rows, "bucket long, node long, n long, c long, cluster long")).collect()
    assert (whole.kind, whole.main, whole.pairs) == (0, 0, 600 * 100)


def test_whole_table_as_in_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sorted(con.execute("SELECT doc_id, n_shingles, component_id, kept FROM (" + oracles.NEAR_DUPLICATES + ")").fetchall())
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op7_minmax_near_duplicates(spark, small).collect()) == want


def test_near_duplicate_edges(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (5, None), (9, "a b c d e"), (2, "p q r s t")]
    got = sorted(map(tuple, minmax_dedup.near_duplicates(table(spark, rows), 4, 80).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (5, 0, 5, True), (9, 2, 5, False), (2, 2, 2, True)], key=repr)
    kept = minmax_dedup.keep_one(table(spark, rows), 4, 80)
    assert kept.schema == table(spark, rows).schema
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([None, 5, 5, 5, 2], key=repr)
    assert minmax_dedup.near_duplicates(table(spark, rows).limit(0), 4, 80).count() == 0
    assert minmax_dedup.keep_one(table(spark, rows).limit(0), 4, 80).count() == 0
    long = " ".join(map(str, range(200_000)))
    r = minmax_dedup.near_duplicates(table(spark, [(1, long), (2, long + " end")]), 4, 80).orderBy("doc_id").collect()
    assert [(x.n_shingles, x.component_id) for x in r] == [(199_997, 1), (199_998, 1)]


def test_signature_estimates_similarity():
    """Minima and maxima agree with the chance that the sets' similarity says."""
    rng = np.random.default_rng(5)
    a, shared = rng.integers(0, 1 << 63, 200).astype(np.uint64), rng.integers(0, 1 << 63, 800).astype(np.uint64)
    b = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    x, y = minmax_dedup.signature(np.concatenate([a, shared]), 2000), minmax_dedup.signature(np.concatenate([b, shared]), 2000)
    for half in (slice(0, 2000), slice(2000, 4000)):
        assert (x[half] == y[half]).mean() == pytest.approx(2 / 3, abs=0.05)


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for u, v in links:
        x, y = root(u), root(v)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: root(k) for u, v in links if u != v for k in (u, v)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# licenses


def plain_best(template, words):
    """Highest share of the template's words found in order in any stretch of a text, by the longest common subsequence."""
    best = 0
    for start in range(len(words)):
        row = [0] * (len(template) + 1)
        for w in words[start : start + len(template) + 12]:
            for j in range(len(template), 0, -1):
                if template[j - 1] == w:
                    row[j] = max(row[j], row[j - 1] + 1)
            for j in range(1, len(template) + 1):
                row[j] = max(row[j], row[j - 1])
        best = max(best, row[-1])
    return best / len(template)


def test_licenses_are_found_where_they_were_put(spark):
    rng = random.Random(2)
    filler = ["river", "stone", "quiet", "letters", "morning", "walked", "öffnet", "table"]
    rows, want = [], {}
    names = sorted(license_scan.TEMPLATES)
    for k in range(120):
        before, after = (" ".join(rng.choice(filler) for _ in range(rng.randint(0, 60))) for _ in range(2))
        name = names[k % len(names)]
        text = license_scan.TEMPLATES[name]
        words = text.split()
        if k % 3 == 1:  # another case and marks between
            text = " ** ".join(words).upper()
        elif k % 3 == 2 and len(words) > 25:  # a few words changed
            for _ in range(3):
                words[rng.randrange(2, len(words) - 2)] = rng.choice(filler)
            text = " ".join(words)
        if k % 5 == 4:
            text = ""
        rows.append((k, f"{before} {text} {after}".strip()))
        want[k] = {name} if text else set()
    found = {}
    for r in license_scan.scan(table(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append(r)
    texts = dict(rows)
    for k, names_ in want.items():
        hits = found.get(k, [])
        assert {h.license for h in hits} >= names_ and (names_ or not hits), k
        for h in hits:
            template = [w.lower() for w in license_scan.WORD.findall(license_scan.TEMPLATES[h.license])]
            span = [w.lower() for w in license_scan.WORD.findall(texts[k][h.start : h.end])]
            assert h.coverage == h.matched_words / len(template) >= 0.8
            assert plain_best(template, span) == pytest.approx(h.coverage)
            assert span[0] in template and span[-1] in template


def test_scan_of_whole_table_misses_nothing(spark, small):
    """Every document in which some stretch matches a template by brute force is reported, and no other."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {(r.doc_id, r.license): r for r in op2_winnowed_license_scan(spark, small).collect()}
    short = {n: [w.lower() for w in license_scan.WORD.findall(t)] for n, t in license_scan.TEMPLATES.items() if len(t) < 90}
    checked = 0
    for k, text in docs.items():
        words = [w.lower() for w in license_scan.WORD.findall(text)]
        for n, t in short.items():
            if not set(t[1:]) <= set(words) and not (k, n) in got and len(set(t) & set(words)) < 0.8 * len(set(t)):
                continue
            best = plain_best(t, words)
            checked += best >= 0.8
            assert ((k, n) in got) == (best >= 0.8) or any(j == k and o != n and got[j, o].coverage > best for j, o in got), (k, n, best)
    assert checked


def test_scan_edges(spark):
    rows = [(1, None), (2, ""), (3, "MIT"), (None, "x. Released under the MIT License. y"), (4, "Released under the MIT License. " * 3), (4, "Released under the MIT License."), (5, "word " * 100_000 + "Released under the MIT License.")]
    got = license_scan.scan(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == sorted([("None", "MIT-notice"), *[("4", "MIT-notice")] * 4, ("5", "MIT-notice")])
    assert license_scan.scan(table(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError, match="words of templates"):
        license_scan.Scanner({"x": "word " * 200_001})


def test_fingerprints_are_guaranteed():
    """Whatever two rows of characters share over GRAM + WINDOW - 1 characters has a fingerprint in common."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        common = rng.integers(97, 123, license_scan.GRAM + license_scan.WINDOW - 1).astype(np.uint32)
        a, b = (np.concatenate([rng.integers(97, 123, rng.integers(0, 40)), common, rng.integers(97, 123, rng.integers(0, 40))]).astype(np.uint32) for _ in range(2))
        assert set(license_scan.winnow(a)[0].tolist()) & set(license_scan.winnow(b)[0].tolist())


# nearest neighbours


def brute_nearest(ids, x, q, k):
    keep = ids != ids[q]
    d = np.sqrt(((x[keep] - x[q]) ** 2).sum(axis=1))
    order = np.lexsort((ids[keep], d))[:k]
    return list(zip(ids[keep][order].tolist(), d[order].tolist()))


def test_recall_and_distances(spark):
    data = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.asarray([r.vec_id for r in rows]), np.asarray([r.embedding for r in rows], np.float64)
    got = {}
    for r in op3_hash_prefix_forest(spark, data).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    hits, place = 0, {int(i): k for k, i in enumerate(ids)}
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        for r in found:
            assert r.vec_id != q and r.score == pytest.approx(float(np.sqrt(((x[place[r.vec_id]] - x[place[q]]) ** 2).sum())), rel=1e-12)
        hits += len({r.vec_id for r in found} & {i for i, _ in brute_nearest(ids, x, place[q], 10)})
    assert hits >= 0.9 * 10 * len(got)


def test_neighbour_edges(spark):
    schema = "vec_id long, embedding array<float>, v int, rank string"
    one = [1.0, 0.0]
    rows = [(0, one), (100, one), (1, one), (1, [0.0, 1.0]), (2, [3.0, 4.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (200, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (None, one), (9, [])]
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], schema)
    got = prefix_forest.search(df, df.vec_id % 100 == 0, k=10).orderBy("query_id", "rank").collect()
    near = [(1, 0.0), (1, 2**0.5), (2, 20**0.5)]
    for q, other in ((0, 100), (100, 0)):
        mine = [(r.vec_id, round(r.score, 9)) for r in got if r.query_id == q]
        assert mine == [(i, round(s, 9)) for i, s in sorted([(other, 0.0), *near], key=lambda p: (p[1], p[0]))]
    assert {r.query_id for r in got} == {0, 100}
    assert prefix_forest.search(df.limit(0), df.vec_id % 100 == 0).count() == 0
    assert prefix_forest.search(df.where("vec_id = 4"), df.vec_id % 100 == 0).count() == 0


def test_many_blocks_and_shards_agree(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in prefix_forest.search(df, df.vec_id % 10 == 0, k=5, share=1.0, block=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    ids = np.arange(600)
    assert got.keys() == {k for k in range(0, 600, 10)}
    for q, found in got.items():  # a share of 1 makes it exact
        assert [i for _, i in sorted(found)] == [i for i, _ in brute_nearest(ids, x, q, 5)]


def test_unclean_tables_give_the_clean_ones_neighbours(spark):
    """Most rows are null, zero, of another length or not finite, and so would most of a sample be."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 6))
    odd = [None, [0.0] * 6, [1.0] * 5, [float("nan")] * 6, [float("-inf")] + [0.0] * 5, [None] * 6, []]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, odd[k % len(odd)]) for k in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in prefix_forest.search(df, df.vec_id % 20 == 0, k=4, share=1.0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert found.keys() == {k for k in range(0, 200, 20)}
    for q, near in found.items():
        assert [i for _, i in sorted(near)] == [i for i, _ in brute_nearest(np.arange(200), x, q, 4)]
    # a full last block, and ids below zero
    again = prefix_forest.search(df.where("vec_id < 200").selectExpr("vec_id - 100 as vec_id", "embedding"), "vec_id % 20 = 0", k=4, share=1.0, block=5)
    assert {(r.query_id + 100, r["rank"], r.vec_id + 100) for r in again.collect()} == {(q, *n) for q, near in found.items() for n in near}
