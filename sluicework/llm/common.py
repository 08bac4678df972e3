"""Helpers that several operators of this subpackage share.

Everything that outlives one task is kept in the folder that the session names in
``spark.checkpoint.dir``: driver and executors share nothing else.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import spread

#: ``\s`` of the pre-tokenizer (the Unicode property White_Space), as a character class of ``re``.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by whatever file system the path names; a small one is dealt over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder.

    Where none is set, a temporary one is made on a single machine (local mode, as in tests); on a
    cluster, whose machines would not see each other's, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sluicework-')}"
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; two calls never give the same one."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``fresh_path`` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables that one call writes below the shared folder and deletes as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, label: str) -> DataFrame:
        path = fresh_path(self.spark, label)
        out = written(df, label, path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove_path(self.spark, self.paths.pop(id(table))[1])


_held: dict[str, tuple] = {}


def claim(name: str, *drop, beside: tuple[str, ...] = ()) -> None:
    """What a Python worker remembers for other operators is dropped: a worker outlives many stages.

    ``drop`` are calls that free this operator's own memory, once another one claims the worker.
    Buffers of earlier tasks' batches go back to the system as well, which Arrow would keep.
    """
    others = [n for n in _held if n != name and n not in beside]
    for other in others:
        for free in _held.pop(other):
            free()
    _held[name] = drop
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that other columns' names can't clash; null text is ''."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def fold(id_col: str = "doc_id"):
    """Remainder of the id's crc32 by 4; remainder 2 is held out of all training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def labelled_rows(labels: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of every labelled document outside the held-out fold, as a written table.

    Rows without id or label, or whose document is gone, take no part; a document that is labelled
    several times counts once, by its highest label.
    """
    d = documents_of(docs)
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
        .where(fold() != 2)
        .join(d.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    )
    return written(rows, "labels")


def labelled_sample(rows: DataFrame, docs: DataFrame, per_class: int) -> tuple[DataFrame, list[int]]:
    """A bounded training sample of ``labelled_rows``, and how many rows of each class there were.

    At most ``per_class`` documents of each class, chosen by a hash of the id, each with one text: the
    least of those that share its id. Returns (doc_id, text, y).
    """
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    top = [rows.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    # at most 2 * per_class rows of two numbers: a proven bound
    texts = documents_of(docs).join(F.broadcast(top[0].unionAll(top[1])), "doc_id")
    # only the sampled documents' texts are grouped; copies of one id meet map-side first
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), [counts.get(0, 0), counts.get(1, 0)]


def value_at(table: DataFrame, column: str, rank: int, bins: int = 1024) -> float:
    """The ``rank``-th smallest number of a column (from 1), exactly, whatever the partitioning.

    Each pass counts in at most ``bins`` bins between the bounds and goes on within the one that holds
    the rank; no values reach the driver. Nulls take no part; rank must lie within the rows' number.
    """
    x = F.col(column)
    low, high = table.agg(F.min(x), F.max(x)).first()
    while low < high:
        part = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
        rows = table.where((x >= low) & (x <= high)).groupBy(part.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).orderBy("bin").collect()
        for r in rows:
            if rank <= r.n:
                low, high = r.low, r.high
                break
            rank -= r.n
    return float(low)


def stay_by_text(docs: DataFrame, stay: Callable[[Iterator[str]], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` for whose texts (null: empty) ``stay`` says so; all columns as they were.

    Rows are judged where they are read: texts are neither shuffled nor joined. The column is found
    as Spark would resolve its name, and told to the workers by its place.
    """
    names = docs.columns
    place = names.index(text_col) if text_col in names else [c.lower() for c in names].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(stay(t.as_py() or "" for t in batch.column(place)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
