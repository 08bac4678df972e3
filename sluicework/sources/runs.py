"""A run's checkpoints as a ledger of small JSON files, each put in place whole or not at all."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig

SCHEMA = "completed_steps long, train_batches_seen long, val_batches_seen long, config map<string,string>"
#: Settings that may differ between a run and its continuation.
FREE = ("device", "checkpoint_dir")


def commit(spark: SparkSession, folder: str, run: RunConfig, completed_steps: int, train_seen: int, val_seen: int) -> None:
    """Writes a checkpoint's entry beside its place and renames it there; a later one of the same step replaces it."""
    row = {"completed_steps": completed_steps, "train_batches_seen": train_seen, "val_batches_seen": val_seen, "config": {k: str(v) for k, v in asdict(run).items()}}
    jvm = spark.sparkContext._jvm
    path = lambda end: jvm.org.apache.hadoop.fs.Path(f"{folder}/checkpoint-{completed_steps:012d}.{end}")
    filesystem = path("json").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = filesystem.create(path("tmp"), True)
    try:
        out.write(bytearray(json.dumps(row).encode()))
    finally:
        out.close()
    filesystem.delete(path("json"), False)
    if not filesystem.rename(path("tmp"), path("json")):
        raise OSError(f"checkpoint {completed_steps} could not be put in place")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """SCHEMA of every checkpoint that was put in place."""
    return spark.read.schema(SCHEMA).option("pathGlobFilter", "checkpoint-*.json").json(folder)


def resume(spark: SparkSession, folder: str, run: RunConfig, step: int | None = None) -> tuple[int, int, int]:
    """(completed_steps, train_batches_seen, val_batches_seen) of a checkpoint, the latest if no step is given.

    One that holds weights only (no completed_steps), or was made with other settings, is an error.
    """
    rows = entries(spark, folder)
    found = (rows if step is None else rows.where(F.col("completed_steps").isNull() | (F.col("completed_steps") == step))).orderBy(F.desc_nulls_last("completed_steps")).limit(1).collect()
    if not found:
        raise FileNotFoundError(f"no checkpoint in {folder}")
    if found[0].completed_steps is None or found[0].train_batches_seen is None:
        raise ValueError("a checkpoint of weights only can't be resumed")
    saved = found[0].config or {}
    if changed := [k for k, v in asdict(run).items() if k not in FREE and saved.get(k) != str(v)]:
        raise ValueError(f"settings have changed since: {changed}")
    return found[0].completed_steps, found[0].train_batches_seen, found[0].val_batches_seen
