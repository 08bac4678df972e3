"""Quality rules by tokeniser fertility, beside a few counts of words and lines.

Public vocabularies measure each whole text: characters of words per token, the share of tokens
that are byte fallbacks, and the entropy of its tokens against the highest one that so many
tokens can have. Texts that pass the base rules set rejection bands for their language (or the
script that most of their letters have, where no language is given): fences as far outside the
quartiles as ``SPREAD`` times the distance between them, computed over all such documents, and
farther for texts of under ``SETTLED`` words, whose measures vary more.
A language is judged by its own quartiles, however few its documents; the distance between them is
drawn towards the mean one within all languages, which weighs as much as ``FEW`` documents.

One pass reads the texts; its rows of numbers are kept as a table in the shared folder, from which
the bands are made and the verdicts given. No text is shuffled. Quartiles are exact over measures
rounded to ``STEP``, from counts that add up in any order, so verdicts don't depend on how rows lie.

Edge cases: null and empty texts have no words and fail the base rules; texts whose words give
no token have no fertility and are judged by the base rules alone; repeated rows are judged
each; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, written
from .vocabulary import piece_encoder

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
#: SPREAD and SETTLED reject most documents of quality 0 among those that reject at most 1 of 100
#: of quality 1, by the labels of sf0.1 outside the held-out fold.
SPREAD, FEW, SETTLED = 1.3, 50, 400
#: What measures are rounded to for the quartiles.
STEP = 0.0001
#: Words whose pieces a worker keeps.
KEPT = 300_000
#: First code points of the scripts told apart where the language is missing.
SCRIPTS = [(0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Indic"), (0xE00, "Thai"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD800, "Other")]
SCHEMA = "doc_id long, language string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_piece double, chars_per_byte_token double, fallback_share double, entropy_share double"
MEASURES = {"chars_per_piece": (True, True), "chars_per_byte_token": (True, True), "fallback_share": (False, True), "entropy_share": (True, False)}


class Pieces(dict):
    """Piece ids of single words by a sentencepiece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.fallback = np.asarray([self.processor.IsByte(k) for k in range(self.processor.GetPieceSize())])

    def __missing__(self, word: bytes) -> bytes:
        ids = np.asarray(self.processor.encode(word.decode("utf-8", "replace"), num_threads=1), "<u4").tobytes()
        if len(self) < KEPT and len(word) < 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text with these words."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows, repeated = list(zip(words, words[1:], words[2:])), 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        inside = np.zeros(len(words), bool)
        at = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
        inside[:-2] |= at
        inside[1:-1] |= at
        inside[2:] |= at
        repeated = int(inside.sum())
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def script_of(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    letters = points[(points > 0x7F) | ((points | 32) >= 97) & ((points | 32) <= 122)]
    if not len(letters):
        return "None"
    at = np.bincount(np.searchsorted([s for s, _ in SCRIPTS], letters, "right") - 1, minlength=len(SCRIPTS))
    totals = Counter()
    for n, (_, name) in zip(at.tolist(), SCRIPTS):
        totals[name] += n
    return min(totals, key=lambda k: (-totals[k], k))


def measures(docs: DataFrame, piece_path: str, byte_path: str) -> DataFrame:
    """SCHEMA of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("encoding", piece_encoder.cache_clear, beside=("fertility",))
        claim("fertility", pieces.cache_clear, beside=("encoding",))
        table, encoder = pieces(piece_path), piece_encoder(byte_path)
        get, fallback = table.__getitem__, table.fallback
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), *[pa.int64()] * 5, *[pa.float64()] * 4]
        for batch in batches:
            rows = []
            for doc_id, text, language in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                words = text.encode("utf-8", "replace").split()
                n, chars, *rest = base_counts(text, words)
                row = [doc_id, language or script_of(text), n, chars, *rest]
                # each distinct word's pieces once, and how often it occurs
                distinct = Counter(words)
                found = list(map(get, distinct))
                ids = np.frombuffer(b"".join(found), "<u4")
                if len(ids):
                    times = np.repeat(np.fromiter(distinct.values(), np.int64, len(found)), np.fromiter(map(len, found), np.int64, len(found)) // 4)
                    total = int(times.sum())
                    order = np.argsort(ids)
                    first = np.flatnonzero(np.diff(ids[order], prepend=len(fallback)))
                    counts = np.add.reduceat(times[order], first) / total
                    top = math.log2(min(total, len(fallback))) or 1.0
                    row += [chars / total, chars / max(len(encoder.encode(text)) // 4, 1), float(times[fallback[ids]].sum() / total), float(-(counts * np.log2(counts)).sum()) / top]
                else:
                    row += [None] * 4
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)

    columns = [F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang")]
    return docs.select(*columns).mapInArrow(run, SCHEMA)


def bands(measured: DataFrame, spread: float = SPREAD) -> DataFrame:
    """Per language: the quartiles of each measure, and how far outside them is kept."""
    good = measured.where("not base_failed and chars_per_piece is not null")
    # a row for each value that occurs, summed up in each task first
    stacked = good.select("language", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.round(F.col(m) / STEP).cast("long").alias("value")) for m in MEASURES))).alias("x"))
    counts = stacked.groupBy("language", "x.measure", "x.value").agg(F.count("*").alias("k"))
    own_rows = Window.partitionBy("language", "measure")
    below = counts.withColumn("n", F.sum("k").over(own_rows)).withColumn("upto", F.sum("k").over(own_rows.orderBy("value")))
    at = lambda share: F.min(F.when(F.col("upto") >= F.ceil(share * F.col("n")), F.col("value"))) * STEP
    wide = below.groupBy("language").pivot("measure", list(MEASURES)).agg(F.max("n").alias("n"), at(F.lit(0.25)).alias("q1"), at(F.lit(0.75)).alias("q3"))
    own = written(wide.select("language", F.col("chars_per_piece_n").alias("n"), *(x for m in MEASURES for x in (F.col(f"{m}_q1").alias(f"q1_{m}"), F.col(f"{m}_q3").alias(f"q3_{m}"), (F.col(f"{m}_q3") - F.col(f"{m}_q1")).alias(f"own_{m}")))), "quartiles")
    # the distance within languages, not that of all documents together, which holds their differences too
    degrees = F.greatest(F.col("n") - 1, F.lit(0))
    pooled = own.agg(*(F.coalesce(F.sum(degrees * F.col(f"own_{m}")) / F.nullif(F.sum(degrees), F.lit(0)), F.lit(0.0)).alias(f"pool_{m}") for m in MEASURES))
    # a share that hardly varies gets a hundredth on either side at least
    span = lambda m: spread * (F.col("n") * F.col(f"own_{m}") + FEW * F.col(f"pool_{m}")) / (F.col("n") + FEW) + 0.01
    return own.crossJoin(F.broadcast(pooled)).select("language", "n", *(x for m in MEASURES for x in (f"q1_{m}", f"q3_{m}", span(m).alias(f"span_{m}"))))


def judge(docs: DataFrame, piece_path: str, byte_path: str) -> DataFrame:
    """Every document's counts and measures, base_failed and kept."""
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    measured = written(measures(docs, piece_path, byte_path).withColumn("base_failed", failed), "fertility")
    limits = written(bands(measured), "bands")  # a row for each language
    # short texts vary more: the fences stand off by the square root of what they lack in words
    wide = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(SETTLED)) / F.greatest(F.col("n_words"), F.lit(1))))
    inside = F.lit(True)
    for m, (low, high) in MEASURES.items():
        if low:
            inside &= F.coalesce(F.col(m) >= F.col(f"q1_{m}") - wide * F.col(f"span_{m}"), F.lit(True))
        if high:
            inside &= F.coalesce(F.col(m) <= F.col(f"q3_{m}") + wide * F.col(f"span_{m}"), F.lit(True))
    return measured.join(limits, "language", "left").withColumn("kept", ~F.col("base_failed") & inside)


def counts_and_verdicts(docs: DataFrame, piece_path: str, byte_path: str) -> DataFrame:
    return judge(docs, piece_path, byte_path).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES)
