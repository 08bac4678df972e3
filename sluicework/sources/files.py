"""Reading and writing corpora, blobs and vocabularies."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SPECIAL_IDS
from ..operators.bpe import shown, vocabulary

FORMATS = ("parquet", "json", "csv", "orc", "text")


def load_source(spark: SparkSession, paths: str | list[str], text_field: str = "text", kind: str = "parquet", keep: tuple[str, ...] = ()) -> DataFrame:
    """A dataset's text column, renamed, and the columns to keep. A list of paths reads those files only."""
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {FORMATS}")
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    rows = reader.format(kind).load(paths)
    return rows.select(*keep, F.col("value" if kind == "text" else text_field).alias("text"))


def pinned_files(df: DataFrame) -> DataFrame:
    """(path, bytes, modified): what a read saw, to be kept in the ledger as its revision."""
    meta = F.col("_metadata")
    return df.select(meta["file_path"].alias("path"), meta["file_size"].alias("bytes"), meta["file_modification_time"].alias("modified")).distinct()


def read_pinned(spark: SparkSession, pins: DataFrame, kind: str = "parquet") -> DataFrame:
    """Exactly the files of ``pinned_files``; a file that has changed since, or is gone, is an error.

    There is a row of ``pins`` for each file, never for each record.
    """
    paths = [r.path for r in pins.select("path").orderBy("path").collect()]
    rows = spark.read.format(kind).load(paths)
    now = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    both = pins.withColumn("path", plain("path")).join(now.withColumn("path", plain("path")), ["path", "bytes", "modified"], "left_anti")
    if changed := both.limit(1).collect():
        raise ValueError(f"{changed[0].path} isn't what was pinned")
    return rows


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSONL with a text on each line; no schema is inferred."""
    return spark.read.schema("text string").json(path)


def write_corpus(docs: DataFrame, path: str) -> None:
    """JSONL, a file for each task; every row is written."""
    docs.select(F.to_json(F.struct("text")).alias("value")).write.text(path)


def gunzipped(body: pd.Series, encoding: pd.Series) -> pd.Series:
    """Texts of gzipped bytes; whatever fails gives an empty text."""

    def one(data, name):
        try:
            return gzip.decompress(data).decode(name or "utf-8", "replace")
        except Exception:
            return ""

    return pd.Series([one(b, e) for b, e in zip(body, encoding)], dtype=object)


def gzipped(text: pd.Series) -> pd.Series:
    """Gzipped UTF-8 bytes of texts; null stays null."""
    return pd.Series([None if t is None else gzip.compress(t.encode(), 1, mtime=0) for t in text], dtype=object)


def id_sums(data: pd.Series) -> pd.Series:
    """Sums of little-endian 16-bit ids."""
    return pd.Series([int(np.frombuffer(d, "<u2").sum(dtype=np.int64)) for d in data], dtype="int64")


def with_blobs(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows (blob_id, src_encoding, ...) with ``text`` from blobs (key, body gzip); "" where there is none.

    ``fetched`` says whether it could be read, so empty documents can be counted.
    """
    unzip = F.pandas_udf(gunzipped, "string")
    bodies = blobs.select(F.regexp_extract("key", r"content/(.*)", 1).alias("blob_id"), "body")
    both = rows.join(bodies, "blob_id", "left").withColumn("text", F.when(F.col("body").isNotNull(), unzip("body", F.coalesce("src_encoding", F.lit("utf-8")))).otherwise(F.lit("")))
    return both.withColumn("fetched", F.col("text") != "").drop("body")


def read_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """(key, body) of the files below ``folder``; the key begins with content/."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.concat(F.lit("content/"), F.element_at(F.split("path", "/content/"), -1)).alias("key"), F.col("content").alias("body"))


def fetch_blobs(rows: DataFrame, connect, fetch) -> DataFrame:
    """As ``with_blobs`` where objects come from a service: one client for each task.

    ``connect()`` makes a client, ``fetch(client, key)`` returns the gzipped bytes.
    """
    schema = rows.withColumn("text", F.lit("")).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for part in parts:
            client = client or connect()
            bodies = []
            for blob in part["blob_id"]:
                try:
                    bodies.append(fetch(client, f"content/{blob}"))
                except Exception:
                    bodies.append(b"")
            yield part.assign(text=gunzipped(pd.Series(bodies, dtype=object), part["src_encoding"]).to_numpy())

    return rows.mapInPandas(run, schema)


def _put(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _got(spark: SparkSession, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content).decode()


def write_vocabulary(spark: SparkSession, merges: list[tuple], vocab_path: str, merges_path: str) -> None:
    """Vocabulary as JSON and merges as text, both in printable characters; special tokens as they are.

    Paths are of any file system that Spark writes to.
    """
    known = {i: shown(t) for i, t in vocabulary(merges).items()}
    _put(spark, vocab_path, json.dumps({t: i for i, t in known.items()} | SPECIAL_IDS, ensure_ascii=False))
    _put(spark, merges_path, "#version: 0.2\n" + "".join(f"{known[a]} {known[b]}\n" for a, b, *_ in merges))


def read_merges(spark: SparkSession, vocab_path: str, merges_path: str) -> list[tuple[int, int]]:
    ids = json.loads(_got(spark, vocab_path))
    return [(ids[a], ids[b]) for a, _, b in (x.partition(" ") for x in _got(spark, merges_path).split("\n")[1:] if x)]
