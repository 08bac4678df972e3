"""Commands: python -m sluicework {shards, metrics, train-tokenizer, gate, resume} ...

Inputs are folders of Parquet files, one below --data for each source's slug, with a text column.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions.text import source_slug
from .operators import bpe, corpus, ledger, sharding
from .sources import files, runs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sluicework")
    commands = top.add_subparsers(dest="command", required=True)
    shards = commands.add_parser("shards", help="write the shard plan's sources")
    which = shards.add_mutually_exclusive_group(required=True)
    which.add_argument("--all", action="store_true")
    which.add_argument("-c", "--category")
    which.add_argument("-r", "--repo-id")
    shards.add_argument("--plan", help="YAML file; the built-in plan if not given")
    metrics = commands.add_parser("metrics", help="a tokenizer's ratios by source")
    metrics.add_argument("--mix", default="ladder")
    metrics.add_argument("--sample-size", type=int, default=2000)
    train = commands.add_parser("train-tokenizer", help="learn merges and write both files")
    train.add_argument("--merges", type=int, default=None)
    train.add_argument("--on-cluster", action="store_true")
    for c in (shards, metrics, train):
        c.add_argument("--data", required=True)
        c.add_argument("--vocab", required=True)
        c.add_argument("--merge-file", required=True)
    shards.add_argument("--out", required=True)
    gate = commands.add_parser("gate", help="check a run's losses (Parquet: run, step, loss)")
    gate.add_argument("kind", choices=["step0", "overfit"])
    gate.add_argument("--losses", required=True)
    resume = commands.add_parser("resume", help="where a run goes on")
    resume.add_argument("--config", default="smoke")
    resume.add_argument("--folder", required=True)
    resume.add_argument("--step", type=int)
    return top


def _documents(spark: SparkSession, folder: str, slugs: list[str], text_field: dict[str, str]) -> DataFrame:
    """(slug, doc_id, text) of the sources; doc_id follows the files' order."""
    out = None
    for slug in slugs:
        rows = files.load_source(spark, f"{folder.rstrip('/')}/{slug}", text_field.get(slug, "text")).select(F.lit(slug).alias("slug"), F.monotonically_increasing_id().alias("doc_id"), "text")
        out = rows if out is None else out.unionAll(rows)
    return out


def run(spark: SparkSession, argv: list[str]) -> DataFrame | None:
    """Runs one command; what it finds is a DataFrame."""
    a = parser().parse_args(argv)
    if a.command == "shards":
        plan = config.load_plan(a.plan, a.category, a.repo_id)
        if not plan:
            raise ValueError("the plan has no such source")
        slug = source_slug(F.col("repo_id"), F.col("config"))
        budgets = config.table(spark, [(s.repo_id, s.config, s.tokens) for s in plan], "repo_id string, config string, budget bigint").select(slug.alias("slug"), "budget")
        slugs = [r.slug for r in budgets.select("slug").collect()]
        docs = _documents(spark, a.data, slugs, {n: s.text_field for n, s in zip(slugs, plan)})
        return sharding.write_plan(docs, budgets, files.read_merges(spark, a.vocab, a.merge_file), a.out).groupBy("slug").agg(F.count("*").alias("n_docs"), F.sum("seq_len").alias("n_tokens"))
    if a.command == "metrics":
        mix = config.load_mix(a.mix)
        slugs = [r.slug for r in config.table(spark, [(k, s.repo_id, s.config) for k, s in enumerate(mix)], "k int, repo_id string, config string").orderBy("k").select(source_slug(F.col("repo_id"), F.col("config")).alias("slug")).collect()]
        docs = _documents(spark, a.data, slugs, {n: s.text_field for n, s in zip(slugs, mix)})
        return sharding.tokenizer_report(docs, files.read_merges(spark, a.vocab, a.merge_file), "slug", a.sample_size)
    if a.command == "train-tokenizer":
        docs = files.load_source(spark, a.data)
        merges = sharding.learn(docs, bpe.N_MERGES if a.merges is None else a.merges, "cluster" if a.on_cluster else "driver")
        files.write_vocabulary(spark, merges, a.vocab, a.merge_file)
        return config.table(spark, [(len(merges),)], "n_merges int")
    if a.command == "gate":
        losses = spark.read.parquet(a.losses)
        return ledger.step0_gate(losses.where("step = 0"), config.RunConfig.vocab_size) if a.kind == "step0" else ledger.overfit_gate(losses)
    found = runs.resume(spark, a.folder, config.load_run(a.config), a.step)
    return config.table(spark, [found], "completed_steps bigint, train_batches_seen bigint, val_batches_seen bigint")


if __name__ == "__main__":
    run(SparkSession.builder.appName("sluicework").getOrCreate(), sys.argv[1:]).show(1000, False)
