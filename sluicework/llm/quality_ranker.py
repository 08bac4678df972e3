"""Quality by Bradley-Terry pairwise ranking.

Documents are compared in pairs: that one labelled good beats one labelled bad with probability
sigmoid(w . (f_good - f_bad)), f being statistics of the whole text. w is fitted by the logistic
loss over feature differences; w . f then ranks any document. The cut is a quantile of the scores
of the whole labelled training fold: the share of bad labels in it. Scores are reported
as a logistic function of the distance to that cut, which itself gets ``CUT``.

Training reads at most ``PER_CLASS`` labelled documents of each class (chosen by a hash of the
id, never from the held-out fold) and ``PAIRS`` pairs of them; only their feature vectors reach
the driver. The cut is an exact rank among the labelled documents' scores. ``train_and_score``
reads all texts in one pass for cut and scores alike; a filter, which must know the cut before it
reads, takes a second one. Texts are never shuffled.

Edge cases: null and empty texts have all features 0 and are scored as such; without labels of
both classes nothing can be learned and all documents score ``CUT``, so none is rejected;
repeated rows are scored each; the columns lang and source are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, documents_of, fold, labelled_rows, labelled_sample, stay_by_text, value_at, written

PER_CLASS, PAIRS, CUT = 4000, 40_000, 0.7
#: Marks whose shares of the bytes are features.
_MARKS = {"pipe": b"|", "bang": b"!?", "symbol": b"#*$%&<>=+@^~_\\/{}[]", "stop": b".,;:"}
NAMES = ("length", "upper", "digit", *_MARKS, "wide", "newline", "space", "entropy", "word_length", "distinct", "top_word", "stutter", "marked", "dup_lines", "line_length", "word_spread")
_MARKED = re.compile(r"[^\w\s'.,;:)\"-]$")


def features_of(text: str) -> list[float]:
    """NAMES' values for one text; each is bounded, whatever the text's length."""
    if not text:
        return [0.0] * len(NAMES)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n, count = len(data), np.bincount(data, minlength=256)
    # the second byte of two-byte capitals of Latin-1 lies below that of the small letters
    wide_upper, wide = 0, int(count[0xC0:].sum())
    if count[0xC3]:
        second = data[1:][data[:-1] == 0xC3]
        wide_upper = int((second < 0x9F).sum())
    upper, lower = int(count[65:91].sum()) + wide_upper, int(count[97:123].sum()) + wide - wide_upper
    p = count[count > 0] / n
    words = text.split()
    k = max(len(words), 1)
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()]
    row = [
        math.log1p(len(words)),
        upper / max(upper + lower, 1),
        count[48:58].sum() / n,
        *(count[list(b)].sum() / n for b in _MARKS.values()),
        wide / n,
        count[10] / n,
        count[32] / n,
        -(p * np.log2(p)).sum(),
        min(lengths.mean(), 40.0),
        len(seen) / k,
        max(seen.values(), default=0) / k,
        sum(map(str.__eq__, words, words[1:])) / k,
        sum(1 for w in words if not w[-1].isalnum() and _MARKED.search(w)) / k,
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
        min(lengths.std(), 40.0),
    ]
    return [float(x) for x in row]


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def margin(self, f: np.ndarray) -> np.ndarray:
        """w . f of standardised features, each held within 8 deviations."""
        return np.clip((f - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        z = self.margin(f) - self.cut + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _vectors(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([features_of(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], names=["doc_id", "y", "f"])

    return sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, f array<double>")


def _fitted(labels: DataFrame, docs: DataFrame, label: str, per_class: int, pairs: int) -> tuple[Ranker, DataFrame, list[int]]:
    """A ranker without its cut, the labelled rows, and how many there are of each class; weights None if nothing can be learned."""
    labelled = labelled_rows(labels, docs, label)
    sample, found = labelled_sample(labelled, docs, per_class)
    rows = sorted((r.doc_id, r.y, r.f) for r in _vectors(sample).collect()) if all(found) else []
    f, y = np.asarray([r[2] for r in rows]).reshape(len(rows), len(NAMES)), np.asarray([r[1] for r in rows])
    if not rows or y.min() == y.max():
        return Ranker(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(len(NAMES)), 0.0), labelled, [0, 0]
    share = np.where(y == 1, found[1] / max((y == 1).sum(), 1), found[0] / max((y == 0).sum(), 1))
    mean = np.average(f, axis=0, weights=share)
    scale = np.sqrt(np.average((f - mean) ** 2, axis=0, weights=share))
    ranker = Ranker(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(f.shape[1]), 0.0)
    z = np.clip((f - ranker.mean) / ranker.scale, -8, 8)
    ranker.weights = fit_pairs(z[y == 1], z[y == 0], pairs)
    return ranker, labelled, found


def train(labels: DataFrame, docs: DataFrame, label: str = "quality", per_class: int = PER_CLASS, pairs: int = PAIRS) -> Ranker:
    ranker, labelled, found = _fitted(labels, docs, label, per_class, pairs)
    if any(found):
        ranker.cut = cut_of(margins(docs, ranker).join(labelled, "doc_id"), *found)
    return ranker


def train_and_score(labels: DataFrame, docs: DataFrame, label: str = "quality", per_class: int = PER_CLASS, pairs: int = PAIRS) -> DataFrame:
    """What ``score`` gives with ``train``'s ranker. All texts are read once: their margins, kept as a table, give cut and scores."""
    ranker, labelled, found = _fitted(labels, docs, label, per_class, pairs)
    if not any(found):
        return score(docs, ranker)
    rows = written(margins(docs, ranker), "margins")
    z = F.col("margin") - cut_of(rows.join(labelled, "doc_id"), *found) + math.log(CUT / (1 - CUT))
    scored = rows.withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0)))))
    return scored.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int, rounds: int = 400, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights of the Bradley-Terry model from random preference pairs (a fixed seed), by Adam."""
    rng = np.random.default_rng(7)
    d = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    w, m, v = np.zeros(d.shape[1]), np.zeros(d.shape[1]), np.zeros(d.shape[1])
    for t in range(1, rounds + 1):
        lost = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # probability given to the wrong winner
        g = -(lost @ d) / len(d) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def cut_at(margins: np.ndarray, share: np.ndarray, q: float) -> float:
    """The q-quantile of the margins, each row counting ``share``: halfway between its neighbours."""
    order = np.argsort(margins, kind="stable")
    below = np.cumsum(share[order]) / share.sum()
    k = int(np.searchsorted(below, q - 1e-12))
    nxt = min(k + 1, len(order) - 1)
    return float((margins[order[k]] + margins[order[nxt]]) / 2)


def cut_of(scored: DataFrame, bad: int, good: int) -> float:
    """``cut_at`` the share of bad ones, over a table of margins: each document once, repeats by their mean."""
    rows = written(scored.groupBy("doc_id").agg(F.avg("margin").alias("margin")), "margins")
    return (value_at(rows, "margin", max(bad, 1)) + value_at(rows, "margin", min(bad + 1, bad + good))) / 2


def margins(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, margin) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)  # four short vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        claim("quality")
        for batch in batches:
            f = np.asarray([features_of(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(r.margin(f), pa.float64())], names=["doc_id", "margin"])

    return documents_of(docs).mapInArrow(run, "doc_id long, margin double")


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)  # four short vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        claim("quality")
        for batch in batches:
            f = np.asarray([features_of(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(r.score(f), pa.float64())], names=["doc_id", "score"])

    scored = documents_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """``docs`` without the documents that the model ranks below its cut; all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def stay(texts: Iterator[str]) -> list[bool]:
        claim("quality")
        f = np.asarray([features_of(t) for t in texts]).reshape(-1, len(NAMES))
        return (shared.value.score(f) >= CUT).tolist()

    return stay_by_text(docs, stay)
