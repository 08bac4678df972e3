"""The stages over the smallest tables: each on all its predecessor kept, each against its own operator or all pairs."""

from __future__ import annotations

import re

import corpus_pipeline
from sluicework.llm import quality_ranker, toxicity_mil
from sluicework.llm.common import read_table


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def test_stages(spark, small):
    docs = read_table(spark, small, "documents")
    labels = read_table(spark, small, "labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "near-dedup", "packing"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    clean = corpus_pipeline.toxicity(spark, docs, small).persist()
    toxic = toxicity_mil.score(docs, toxicity_mil.train(labels, docs)).where("predicted = 1")
    assert clean.schema == docs.schema and ids(clean) == ids(docs) - ids(toxic)

    good = corpus_pipeline.quality(spark, clean, small).persist()
    bad = quality_ranker.score(clean, quality_ranker.train(labels, clean)).where("predicted = 0")
    assert good.schema == docs.schema and ids(good) == ids(clean) - ids(bad)

    once = corpus_pipeline.near_duplicates(spark, good, small).persist()
    sets = {r.doc_id: shingles(r.text) for r in good.collect()}
    group = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert once.schema == docs.schema and ids(once) == set(group.values())

    packed = corpus_pipeline.packing(spark, once, small)
    assert ids(packed) == ids(once)
    for r in packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect():
        assert r["sum(length)"] == r["max(doc_tokens)"]
    assert ids(corpus_pipeline.run(spark, small)) == ids(once)


def test_odd_tables(spark, tmp_path):
    """Null and empty texts, null and repeated ids, clashing names and another order of columns; then empty tables."""
    text = "The same words stand here again and again in one quiet line of text."
    rows = [("en", text, 1, "a"), ("en", text, 1, "a"), (None, None, 2, None), ("en", "", 3, "b"), ("de", text, None, "b"), ("de", text + " End", 4, "c"), ("fr", "w " * 30_000, 5, "c")]
    docs = spark.createDataFrame(rows, "lang string, Text string, doc_id long, node string").selectExpr("*", "1.5 as bit", "'x' as digest", "7 as y", "'z' as margin")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    for name, d in (("odd", docs), ("empty", docs.limit(0))):
        folder = str(tmp_path / name)
        d.write.parquet(f"{folder}/documents.parquet")
        (labels if name == "odd" else labels.limit(0)).write.parquet(f"{folder}/labels.parquet")
        kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, corpus_pipeline.toxicity(spark, read_table(spark, folder, "documents"), folder), folder), folder)
        assert kept.schema == read_table(spark, folder, "documents").schema
        pieces = corpus_pipeline.run(spark, folder)
        found = sorted((r.doc_id for r in kept.collect()), key=repr)
        if name == "empty":
            assert found == [] and pieces.count() == 0
        else:  # document 4 shares 10 of 11 shingles with 1, of which both rows stay
            assert found == sorted([1, 1, 2, 3, None, 5], key=repr)
            assert sorted({r.doc_id for r in pieces.collect()}, key=repr) == sorted({*found}, key=repr)
