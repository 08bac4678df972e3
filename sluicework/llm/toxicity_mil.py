"""Toxicity by multiple-instance learning.

A document is a bag of sentences of which only the bag's label is known. A sentence's probability
is a logistic function of the character n-grams of its distinct words, a document's is the
noisy-or of its bag: 1 - prod(1 - p_s). Both are trained together from document labels; afterwards
the sentences' own probabilities say where the offence is. A bag holds each sentence once, by the
n-grams found in it, so repeating a sentence changes nothing; training and scoring make their bags
by the same function.

Training: at most ``PER_CLASS`` labelled documents of each class (chosen by a hash of the id,
never from the held-out fold), one text of each. Executors count in how many documents of each
class each n-gram occurs; of those that lean to the toxic class the ``FEATURES`` with the highest
likelihood ratio become features, and regularisation decides on their weights. Sentences without
any of them carry no evidence and have probability 0. What reaches the driver is FEATURES n-grams,
and the bags of the sampled documents as lists of feature numbers. Scoring runs over all whole
texts; an automaton finds all features in one pass.

Edge cases: null and empty texts score 0; without any label of either class, nothing can be
learned and all score 0; repeated rows are scored each; a label of a missing document is not
used; of several texts under a labelled id the first by value is learned; the columns lang and
source are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, documents_of, fold, labelled_rows, labelled_sample, stay_by_text

#: FEATURES and DECAY were chosen within the training folds of sf0.01 and sf0.1.
PER_CLASS, FEATURES, DECAY = 3000, 1024, 1e-2
#: N-gram lengths; a word's edges are marked.
SIZES = (4, 5, 6)
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"[^\W\d_]+")
#: Words whose n-grams one worker remembers in training.
KEPT = 20_000


def grams_of(word: str) -> tuple[str, ...]:
    """A lower-case word's n-grams and the word itself, each once."""
    w = f"<{word}>"
    return tuple({w, *(w[k : k + n] for n in SIZES for k in range(len(w) - n + 1))})


def sentences_of(text: str) -> list[str]:
    return [s for s in SENTENCE_END.split(text) if s]


class Finder:
    """Finds the features in a sentence's distinct words."""

    def __init__(self, grams: list[str]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, g in enumerate(grams):
            self.automaton.add_word(g, k)
        self.some = bool(grams)
        self.automaton.make_automaton()

    def sentence(self, s: str) -> tuple[int, ...]:
        """Numbers of the features, in order, each as often as it occurs."""
        words = set(WORD.findall(s.lower()))
        return tuple(sorted([k for _, k in self.automaton.iter("<" + "><".join(words) + ">")])) if words and self.some else ()

    def bag(self, text: str) -> set[tuple[int, ...]]:
        found = set(map(self.sentence, sentences_of(text)))
        found.discard(())
        return found


@dataclass
class Model:
    """weights: of the n-grams ``grams``; bias: of a sentence that has any of them."""

    grams: list[str]
    weights: list[float]
    bias: float
    finder: Finder | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"grams": self.grams, "weights": self.weights, "bias": self.bias, "finder": None}  # each worker builds its own

    def found(self) -> Finder:
        if self.finder is None:
            self.finder = Finder(self.grams)
        return self.finder

    def log_odds(self, features: tuple[int, ...]) -> float:
        return self.bias + math.fsum(map(self.weights.__getitem__, features))

    def sentence(self, s: str) -> float:
        """Log-odds that a sentence is toxic; minus infinity where it has no feature."""
        features = self.found().sentence(s)
        return self.log_odds(features) if features else -math.inf

    def document(self, text: str) -> float:
        # minus the log of the product of 1 - p_s
        return -math.expm1(-math.fsum(softplus(self.log_odds(f)) for f in self.found().bag(text)))


def softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def gram_counts(sample: DataFrame) -> DataFrame:
    """(gram, y, n): documents of each class that hold an n-gram; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity training")
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        cache: dict[str, tuple[str, ...]] = {}

        def sums():
            for y in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(list(counts[y]), pa.string()), pa.array([y] * len(counts[y]), pa.int32()), pa.array(list(counts[y].values()), pa.int64())], names=["gram", "y", "n"])
                counts[y].clear()

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                grams: set[str] = set()
                for w in set(WORD.findall(text.as_py().lower())):
                    if (g := cache.get(w)) is None:
                        g = grams_of(w)
                        if len(cache) < KEPT:
                            cache[w] = g
                    grams.update(g)
                counts[y].update(grams)
                if len(counts[0]) + len(counts[1]) > 400_000:  # bounds memory; sums are added up after
                    yield from sums()
        yield from sums()

    return sample.select("text", "y").mapInArrow(run, "gram string, y int, n long")


def train(labels: DataFrame, docs: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    sample, found = labelled_sample(labelled_rows(labels, docs, label), docs, per_class)
    if not all(found):
        return Model([], [], 0.0)
    n0, n1 = (float(min(n, per_class)) for n in found)
    # log-likelihood ratio of "the document holds the n-gram" against the class
    a, b = F.col("pos") + 0.5, F.col("neg") + 0.5
    p1, p0, p = a / (n1 + 1), b / (n0 + 1), (a + b) / (n0 + n1 + 2)
    ll = lambda k, n, q: k * F.log(q) + (n - k) * F.log(F.lit(1.0) - q)
    ratio = ll(a, n1 + 1, p1) + ll(b, n0 + 1, p0) - ll(a, n1 + 1, p) - ll(b, n0 + 1, p)
    chosen = (
        gram_counts(sample).groupBy("gram").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))
        .where(p1 > p0).withColumn("ratio", ratio)
        .orderBy(F.desc("ratio"), "gram").limit(features)  # the documented bound on features
    )
    grams = sorted(r.gram for r in chosen.collect())

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity training")
        finder = Finder(grams)
        for batch in batches:
            out = [sorted(finder.bag(text.as_py())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.list_(pa.int16())))], names=["doc_id", "y", "bag"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(bags, "doc_id long, y int, bag array<array<smallint>>").toArrow().sort_by("doc_id").combine_chunks()
    bag = rows.column("bag").combine_chunks()
    sentences = bag.flatten()
    weights, bias = fit(rows.column("y").to_numpy(), np.asarray(bag.value_lengths()), np.asarray(sentences.value_lengths()), np.asarray(sentences.flatten()), len(grams), [n / min(n, per_class) for n in found])
    return Model(grams, weights.tolist(), bias)


def fit(y: np.ndarray, n_sentences: np.ndarray, n_found: np.ndarray, feature: np.ndarray, n_features: int, per_row: list[float], rounds: int = 150, rate: float = 0.1, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the noisy-or's log-likelihood over all bags.

    y: the documents' labels; n_sentences: how many sentences each one's bag has; n_found: how many
    features each of these has; feature: which ones. Empty bags have probability 0 by definition and
    are left out. per_row: how many labelled documents one of each class stands for.
    """
    w, bias = np.zeros(n_features), -2.0
    some = n_sentences > 0
    y, n_sentences = y[some].astype(float), n_sentences[some]
    if not len(y):
        return w, bias
    sentence_of, doc_of = np.repeat(np.arange(len(n_found)), n_found), np.repeat(np.arange(len(y)), n_sentences)
    first, first_sentence = np.cumsum(n_found) - n_found, np.cumsum(n_sentences) - n_sentences
    weight = np.where(y == 1, per_row[1], per_row[0])
    weight /= weight.mean()
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, rounds + 1):
        z = bias + np.add.reduceat(w[feature], first)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(-np.add.reduceat(np.logaddexp(0, z), first_sentence))
        # d loss / d z_s: p_s for a clean document, -p_s * clean / (1 - clean) for a toxic one
        g_doc = weight * np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        g_s = g_doc[doc_of] * p / len(y)
        g = np.append(np.bincount(feature, g_s[sentence_of], n_features) + decay * w / 10, g_s.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        claim("toxicity")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.document(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    scored = documents_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, place, start, end, sentence, score): sentences whose own probability reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        claim("toxicity")
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                at, t = 0, text.as_py()
                for place, s in enumerate(sentences_of(t)):
                    at = t.index(s, at)
                    z = m.sentence(s)
                    if z > -math.inf and (p := 1 / (1 + math.exp(-z))) >= threshold:
                        out.append((doc_id, place, at, at + len(s), s, p))
                    at += len(s)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=["doc_id", "place", "start", "end", "sentence", "score"])

    return documents_of(docs).mapInArrow(run, "doc_id long, place int, start long, end long, sentence string, score double")


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the documents that the model calls toxic; all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def stay(texts: Iterator[str]) -> list[bool]:
        claim("toxicity")
        return [shared.value.document(t) < threshold for t in texts]

    return stay_by_text(docs, stay)
