"""Run planning: learning rate, calendars, budgets, parameter counts, gates and resumption."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig


def lr_factor(step: Column, n_steps: int, warmup: int) -> Column:
    """Rises over the warm-up, stays at 1, falls over the last tenth."""
    return F.when(step < warmup, step / warmup).when(step < n_steps * 0.9, 1.0).otherwise((n_steps - step) / (n_steps * 0.1))


def lr_schedule(spark: SparkSession, run: RunConfig) -> DataFrame:
    step = F.col("id").alias("step")
    return spark.range(run.n_steps).select(step, lr_factor(F.col("id"), run.n_steps, run.warmup_steps).alias("factor"))


def train_calendar(spark: SparkSession, run: RunConfig) -> DataFrame:
    """(step, first_batch, last_batch, evaluates, saves) of every update."""
    a, every = run.grad_accum_steps, run.checkpoint_every
    saves = ((F.col("id") + 1) % every == 0) | (F.col("id") == run.n_steps - 1)
    return spark.range(run.n_steps).select(F.col("id").alias("step"), (F.col("id") * a).alias("first_batch"), (F.col("id") * a + a - 1).alias("last_batch"), ((F.col("id") > 0) & (F.col("id") % 500 == 0)).alias("evaluates"), saves.alias("saves"))


def checkpoint_calendar(spark: SparkSession, run: RunConfig) -> DataFrame:
    """(completed_steps, train_batches_seen, val_batches_seen) at every checkpoint."""
    rows = train_calendar(spark, run).where("saves")
    evaluations = F.floor(F.col("step") / 500)
    return rows.select((F.col("step") + 1).alias("completed_steps"), (F.col("last_batch") + 1).alias("train_batches_seen"), (evaluations * run.n_val_batches).alias("val_batches_seen"))


def token_budget(runs: DataFrame) -> DataFrame:
    """(run, tokens_per_step, tokens) of rows with batch_size, grad_accum_steps, seq_len, n_steps."""
    per = F.col("batch_size").cast("bigint") * F.col("grad_accum_steps") * F.col("seq_len")
    return runs.select("run", per.alias("tokens_per_step"), (per * F.col("n_steps")).alias("tokens"))


def parameters(runs: DataFrame) -> DataFrame:
    """(run, n_params) from the shapes: embedding, attention, three feed-forward matrices and norms."""
    e = "cast(vocab_size as bigint) * d_model + n_layers * (2L * n_heads * head_dim * d_model + 2L * n_kv_heads * head_dim * d_model + 3L * d_ff * d_model + 2L * d_model) + d_model"
    return runs.select("run", F.expr(e).alias("n_params"))


def setting_diff(saved: DataFrame, current: DataFrame, ignored: tuple[str, ...] = ("device", "checkpoint_dir")) -> DataFrame:
    """(key, saved, current) of the settings (key, value) that forbid resuming."""
    both = saved.withColumnRenamed("value", "saved").join(current.withColumnRenamed("value", "current"), "key", "full_outer")
    return both.where(~F.col("key").isin(*ignored) & ~F.col("saved").eqNullSafe(F.col("current"))).select("key", "saved", "current")


def unknown_settings(given: DataFrame, known: DataFrame) -> DataFrame:
    return given.select("key").join(known.select("key"), "key", "left_anti").distinct()


def resolved(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(key, value): an override where there is one."""
    return defaults.join(overrides.withColumnRenamed("value", "own"), "key", "left").select("key", F.coalesce("own", "value").alias("value"))


def resume_position(ledger: DataFrame, n_batches: int) -> DataFrame:
    """(completed_steps, start_batch, passes): where the stream goes on; a new pass begins when one is used up."""
    seen = F.col("train_batches_seen")
    return ledger.select("completed_steps", (seen % n_batches).alias("start_batch"), F.floor(seen / n_batches).alias("passes"))


def mean_losses(losses: DataFrame, accum: int) -> DataFrame:
    """(step, loss) of micro-batches (batch, loss)."""
    return losses.groupBy(F.floor(F.col("batch") / accum).alias("step")).agg(F.avg("loss").alias("loss"))


def step0_gate(ledger: DataFrame, vocab_size: int, within: float = 0.2) -> DataFrame:
    """(run, loss, expected, passed): an untrained model's loss is near ln(vocabulary)."""
    expected = math.log(vocab_size)
    finite = ~F.isnan("loss") & (F.abs("loss") < float("inf"))
    return ledger.select("run", "loss", F.lit(expected).alias("expected"), F.coalesce(finite & (F.abs(F.col("loss") - expected) < within), F.lit(False)).alias("passed"))


def overfit_gate(ledger: DataFrame, below: float = 0.1) -> DataFrame:
    """(run, loss, passed) of the last step of each run."""
    return ledger.groupBy("run").agg(F.max_by("loss", "step").alias("loss")).withColumn("passed", F.coalesce(F.col("loss") < below, F.lit(False)))
