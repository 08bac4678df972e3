"""Registered queries over whole tables, each beside SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..constants import EOS
from ..functions import text as T
from ..operators import blend, bpe, corpus, kernels, ledger, sharding, shards
from ..sources import files, runs, scratch
from ..sources import shards as shard_files
from ..streaming import ingest
from . import oracles

S, VAL_FRAC, BATCH, WORLD = 256, 0.05, 8, 4
#: Shares of the blend by language, and byte targets of the tokenizer corpus.
BLEND = [(0, "en", 0.5), (1, "fr", 0.25), (2, "de", 0.125), (3, "es", 0.125)]
TARGETS = [(0, "en", 0.55), (1, "fr", 0.2), (2, "de", 0.15), (3, "es", 0.1)]
BUDGET, BYTE_TARGET, MERGES = 20_000, 1_000_000, 5
#: Sources of a small shard plan, one of them with more budget than it has tokens.
PLAN_BUDGETS = [("en", 150_000), ("fr", 20_000), ("de", 1_000_000_000)]
RUN = "run_246m"
LEDGER = [(500 * k, 8000 * k) for k in range(1, 8)]
GATES = [("a", 0, 10.9405), ("b", 0, 11.4), ("c", 0, 10.7), ("a", 1, 0.5), ("a", 2, 0.0224), ("b", 3, 0.3)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scratch.spread(read(spark, sf_dir, "documents"))


def _tokens(spark: SparkSession, sf_dir: str, slug: str = "source") -> DataFrame:
    return shards.byte_documents(_documents(spark, sf_dir), slug)


def _mixes(spark: SparkSession) -> DataFrame:
    return config.table(spark, config.mix_rows(), config.MIX_SCHEMA)


def _runs(spark: SparkSession) -> DataFrame:
    return config.table(spark, *oracles.run_table())


def _settings(spark: SparkSession, name: str) -> DataFrame:
    return config.table(spark, config.setting_rows(name), "key string, value string")


@query
def scan_project_text(spark, sf_dir):
    return files.load_source(spark, f"{sf_dir}/pages.parquet", "html", keep=("page_id",))


@query
def nonempty_filter(spark, sf_dir):
    return _documents(spark, sf_dir).where(T.nonempty(F.col("text"))).select("doc_id", "text")


@query
def blob_lookup_default(spark, sf_dir):
    """Texts by id, empty where there is none: the join of metadata with its blobs."""
    rows, blobs = read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "conversations").where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("body"))
    return rows.join(blobs, rows.doc_id == blobs.conv_id, "left").select("doc_id", "lang", F.coalesce("body", F.lit("")).alias("text"))


@query
def blob_gunzip(spark, sf_dir):
    """Texts from gzipped blobs by key, decoded; rows without a blob have an empty text."""
    rows = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("blob_id"), F.lit(None).cast("string").alias("src_encoding"), "text")
    zipped = F.pandas_udf(files.gzipped, "binary")
    blobs = rows.where("cast(blob_id as bigint) % 3 <> 0").select(F.concat(F.lit("content/"), "blob_id").alias("key"), zipped("text").alias("body"))
    found = files.with_blobs(rows.drop("text"), blobs)
    return found.select(F.col("blob_id").cast("bigint").alias("doc_id"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "fetched")


@query
def blob_fetch(spark, sf_dir):
    """Objects from a service by key, with one client for each task; this one answers with the key."""
    import gzip

    rows = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("blob_id"), F.lit("utf-8").alias("src_encoding"))
    found = files.fetch_blobs(rows, dict, lambda client, key: client.setdefault(key, gzip.compress(key.encode())))
    return found.select(F.col("blob_id").cast("bigint").alias("doc_id"), "text")


@query
def file_subset(spark, sf_dir):
    """Two of a data set's files, by a list of paths."""
    path = scratch.fresh_path(spark, "files")
    docs = read(spark, sf_dir, "documents")
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).write.parquet(f"{path}/{k}")
    return files.load_source(spark, [f"{path}/0", f"{path}/2"], keep=("doc_id",)).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query
def corpus_jsonl_roundtrip(spark, sf_dir):
    """A corpus as JSONL files, read again: how often each text occurs."""
    path = scratch.fresh_path(spark, "corpus")
    files.write_corpus(_documents(spark, sf_dir).select("text"), path)
    return files.read_corpus(spark, path).groupBy(F.md5(F.encode("text", "UTF-8")).alias("text_md5")).agg(F.count("*").alias("n"))


@query
def pinned_read(spark, sf_dir):
    """The files that a first read saw, and only those."""
    pins = files.pinned_files(read(spark, sf_dir, "documents"))
    return files.read_pinned(spark, pins).select("doc_id", "n_chars")


@query
def skip_rows(spark, sf_dir):
    """What a reader goes on with that has seen 100 documents."""
    return corpus.skip_rows(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), 100)


@query
def source_slug(spark, sf_dir):
    return _mixes(spark).select("mix", "ord", "repo_id", "config", T.source_slug(F.col("repo_id"), F.col("config")).alias("slug"))


@query
def source_label(spark, sf_dir):
    return _mixes(spark).select("mix", "ord", "repo_id", "config", "data_dir", T.source_label(F.col("repo_id"), F.col("config"), F.col("data_dir")).alias("label"))


@query
def plan_filter_category(spark, sf_dir):
    plan = config.table(spark, config.plan_rows(), config.PLAN_SCHEMA)
    return plan.where("category = 'code'").select(T.source_slug(F.col("repo_id"), F.col("config")).alias("slug"), "category", "tokens")


@query
def config_resolve(spark, sf_dir):
    own = config.table(spark, [(k, str(v)) for k, v in config.RUNS[RUN].items()], "key string, value string")
    return ledger.resolved(config.table(spark, oracles.default_rows(), "key string, value string"), own)


@query
def resume_config_diff(spark, sf_dir):
    return ledger.setting_diff(_settings(spark, "run_124m"), _settings(spark, RUN))


@query
def unknown_config_keys(spark, sf_dir):
    given = config.table(spark, [("lr", "1"), ("learning_rate", "1"), ("n_layer", "2")], "key string, value string")
    return ledger.unknown_settings(given, _settings(spark, "smoke"))


@query
def mix_missing_shards(spark, sf_dir):
    slug = T.source_slug(F.col("repo_id"), F.col("config")).alias("slug")
    return blend.missing(_mixes(spark).where("mix = 'flagship'").select(slug), config.table(spark, config.plan_rows(), config.PLAN_SCHEMA).select(slug))


@query
def avg_doc_bytes(spark, sf_dir):
    return corpus.avg_doc_bytes(_documents(spark, sf_dir), "source").withColumn("avg_bytes", F.round("avg_bytes", 6))


def _shares(spark, docs):
    targets = config.table(spark, TARGETS, "ord int, lang string, target double")
    return corpus.byte_weighted(corpus.avg_doc_bytes(docs, "lang"), targets, "lang").join(targets.select("lang", "ord"), "lang")


@query
def byte_weighted_probs(spark, sf_dir):
    return _shares(spark, _documents(spark, sf_dir)).select("lang", F.round("avg_bytes", 6).alias("avg_bytes"), F.round("p", 6).alias("p"))


@query
def corpus_byte_cut(spark, sf_dir):
    rows = corpus.byte_cut(_documents(spark, sf_dir).where(T.nonempty(F.col("text"))), BYTE_TARGET, ["doc_id"], F.floor(F.col("doc_id") / 65536))
    return rows.select("doc_id", "line_bytes", "before")


@query
def tokenizer_corpus(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "lang", "text")
    shares = _shares(spark, docs).select("lang", "ord", F.round("p", 6).alias("p"))
    return corpus.tokenizer_corpus(docs, shares, "lang", BYTE_TARGET).select("doc_id", "lang", "j", "line_bytes", "before")


@query
def pretoken_freq(spark, sf_dir):
    return bpe.pretoken_freq(_documents(spark, sf_dir))


@query
def byte_pair_freq(spark, sf_dir):
    return bpe.pair_freq(bpe.pretoken_freq(_documents(spark, sf_dir)))


@query
def bpe_first_merge(spark, sf_dir):
    return bpe.first_merge(bpe.pretoken_freq(_documents(spark, sf_dir)))


@query
def bpe_train_k(spark, sf_dir):
    merges = bpe.train(bpe.pretoken_freq(_documents(spark, sf_dir)), MERGES, "either")
    return config.table(spark, [(k, *m) for k, m in enumerate(merges)], "rank int, l int, r int, n bigint")


@query
def encode_tokens(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    rows = bpe.encode(docs, bpe.train(bpe.pretoken_freq(docs), MERGES, "either"), "doc_id")
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


@query
def decode_roundtrip(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    merges = bpe.train(bpe.pretoken_freq(docs), MERGES, "either")
    back = bpe.decode(bpe.encode(docs, merges, "doc_id"), merges, "doc_id")
    return docs.select("doc_id", "text").join(back.withColumnRenamed("text", "back"), "doc_id").select("doc_id", (F.col("text") == F.col("back")).alias("ok"))


@query
def vocabulary_files(spark, sf_dir):
    """Learned merges written as vocabulary and merge files, and read again."""
    merges = sharding.learn(_documents(spark, sf_dir), MERGES)
    paths = f"{(folder := scratch.fresh_path(spark, 'vocabulary'))}/vocab.json", f"{folder}/merges.txt"
    files.write_vocabulary(spark, merges, *paths)
    return config.table(spark, [(k, *m) for k, m in enumerate(files.read_merges(spark, *paths))], "rank int, l int, r int")


@query
def bpe_train_on_cluster(spark, sf_dir):
    """The same merges with the sequences in a table."""
    merges = sharding.learn(_documents(spark, sf_dir), MERGES, "cluster")
    return config.table(spark, [(k, *m) for k, m in enumerate(merges)], "rank int, l int, r int, n bigint")


@query
def tokenizer_report(spark, sf_dir):
    """Ratios of the learned tokenizer over each source's first 20 documents."""
    docs = _documents(spark, sf_dir)
    found = sharding.tokenizer_report(docs, sharding.learn(docs, MERGES), "source", 20)
    return found.select("source", *(F.round(c, 6).alias(c) for c in ("bytes_per_token", "chars_per_token", "fertility")))


@query
def byte_alphabet(spark, sf_dir):
    return bpe.byte_alphabet(spark)


@query
def tokenizer_metrics(spark, sf_dir):
    m = bpe.metrics(_documents(spark, sf_dir), "source", F.octet_length("text"))
    return m.select("source", *(F.round(c, 6).alias(c) for c in ("bytes_per_token", "chars_per_token", "fertility")))


@query
def shard_index(spark, sf_dir):
    return shards.index(_tokens(spark, sf_dir))


@query
def shard_totals(spark, sf_dir):
    return shards.totals(_tokens(spark, sf_dir))


@query
def shard_get_document(spark, sf_dir):
    return shards.get_document(_tokens(spark, sf_dir), "src3", 7).select("slug", "doc_seq", "seq_len", F.md5(F.hex("data")).alias("ids_md5"))


@query
def shard_get_span(spark, sf_dir):
    return shards.get_span(_tokens(spark, sf_dir), "src3", 1000, 5000).select("slug", F.md5(F.hex("data")).alias("ids_md5"))


def _shard_files(spark, sf_dir) -> str:
    path = scratch.fresh_path(spark, "shards")
    shard_files.write_shards(shards.with_index(_tokens(spark, sf_dir)), path)
    return path


@query
def shard_file_roundtrip(spark, sf_dir):
    """Shards as .bin and .idx files, read again: totals from the files."""
    return shards.totals(shard_files.read_shards(spark, _shard_files(spark, sf_dir)))


@query
def shard_file_documents(spark, sf_dir):
    """One document of each shard, read by its pointer."""
    path = _shard_files(spark, sf_dir)
    wanted = shard_files.index_lengths(spark, path).select("slug", F.lit(7).alias("doc_seq")).distinct()
    return shard_files.documents_at(wanted, path).select("slug", "doc_seq", F.md5(F.hex("data")).alias("ids_md5"))


@query
def shard_file_spans(spark, sf_dir):
    """Tokens across documents, of each shard, read by pointers."""
    path = _shard_files(spark, sf_dir)
    wanted = shard_files.index_lengths(spark, path).select("slug", F.lit(1000).alias("start"), F.lit(2000).alias("length")).distinct()
    return shard_files.spans_at(wanted, path).select("slug", "start", F.md5(F.hex("data")).alias("ids_md5"))


@query
def shard_file_lengths(spark, sf_dir):
    """From the lengths in the indexes alone."""
    pairs = shard_files.index_lengths(spark, _shard_files(spark, sf_dir))
    return pairs.groupBy("slug").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("longest").alias("longest"))


@query
def shard_merged_parts(spark, sf_dir):
    """Each slug's pairs made one, then read."""
    path = _shard_files(spark, sf_dir)
    shard_files.merge_all(spark, path)
    rows = shard_files.read_shards(spark, path)
    return rows.groupBy("slug").agg(F.count("*").alias("n_docs"), F.sum("seq_len").alias("n_tokens"), F.max("part").cast("bigint").alias("last_part"))


@query
def plan_bpe_shards(spark, sf_dir):
    """The plan's sources encoded by learned merges, cut at their budgets, written as shards and read back."""
    docs = _documents(spark, sf_dir).select(F.col("lang").alias("slug"), "doc_id", "text")
    budgets = config.table(spark, PLAN_BUDGETS, "slug string, budget bigint")
    rows = sharding.write_plan(docs, budgets, sharding.learn(docs, MERGES), scratch.fresh_path(spark, "plan"))
    total = F.pandas_udf(files.id_sums, "bigint")(F.col("data"))  # of whole documents, in steps by their length
    return rows.groupBy("slug").agg(F.count("*").alias("n_docs"), F.sum("seq_len").alias("n_tokens"), F.sum(total).alias("id_sum"))


@query
def token_budget_cut(spark, sf_dir):
    kept = corpus.token_budget_cut(_tokens(spark, sf_dir).drop("data"), ["slug"], F.lit(BUDGET))
    return kept.groupBy("slug").agg(F.count("*").alias("n_docs"), F.sum("seq_len").alias("n_tokens"))


@query
def token_budget_cut_parallel(spark, sf_dir):
    """Four parts of each source by document number, each with a fourth of the budget."""
    parts = shards.with_index(_tokens(spark, sf_dir).drop("data")).withColumn("part", F.col("doc_seq") % 4)
    kept = corpus.token_budget_cut(parts, ["slug", "part"], F.lit(BUDGET // 4))
    return kept.groupBy("slug", "part").agg(F.count("*").alias("n_docs"), F.sum("seq_len").alias("n_tokens"))


@query
def streaming_token_budget(spark, sf_dir):
    """The budget cut by a stream of files; the ledger's sums."""
    docs = read(spark, sf_dir, "documents")
    folder = scratch.fresh_path(spark, "ingest")
    # the table is a file or a folder of files: a stream takes both as a pattern only
    stream = ingest.document_stream(spark, f"{sf_dir}/[d]ocuments.parquet", docs.schema, "*", files_per_batch=None)
    ingest.ingest(stream, lambda batch: shards.byte_documents(batch, "source"), folder, BUDGET)
    return ingest.ledger(spark, folder).groupBy("slug").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


@query
def streaming_restarts(spark, sf_dir):
    """The budget cut by a stream that is stopped and goes on from its offsets, twice, as files arrive."""
    docs = read(spark, sf_dir, "documents")
    folder = scratch.fresh_path(spark, "ingest")
    third = F.floor((F.col("doc_id") - docs.agg(F.min("doc_id")).scalar()) * 3 / (docs.agg(F.max("doc_id")).scalar() - docs.agg(F.min("doc_id")).scalar() + 1))
    for k in range(3):
        docs.where(third == k).write.mode("append").parquet(f"{folder}/in")
        # a third is as many files as tasks wrote, and one batch
        ingest.ingest(ingest.document_stream(spark, f"{folder}/in", docs.schema, files_per_batch=None), lambda batch: shards.byte_documents(batch, "source"), folder, BUDGET)
    return ingest.ledger(spark, folder).groupBy("slug").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _bounds(spark, sf_dir, slug="source"):
    return shards.split_bounds(shards.totals(_tokens(spark, sf_dir, slug).drop("data")), S, VAL_FRAC)


@query
def split_bounds(spark, sf_dir):
    return _bounds(spark, sf_dir).select("slug", "cut", "n_train", "n_val")


def _md5s(windows):
    return windows.select("slug", "k", F.md5(F.hex("x")).alias("x_md5"), F.md5(F.hex("y")).alias("y_md5"))


@query
def token_windows(spark, sf_dir):
    return _md5s(shards.windows(_tokens(spark, sf_dir), S, "train", VAL_FRAC))


@query
def token_windows_val(spark, sf_dir):
    return _md5s(shards.windows(_tokens(spark, sf_dir), S, "val", VAL_FRAC))


def _sources(spark, sf_dir):
    """(ds, slug, weight, n_samples) of the blend; as many rows as it has sources."""
    mix = config.table(spark, BLEND, "ds int, slug string, weight double")
    return mix.join(_bounds(spark, sf_dir, "lang").select("slug", F.col("n_train").alias("n_samples")), "slug").select("ds", "slug", "weight", "n_samples")


def _size(sources) -> int:
    return blend.blend_size(sources).first().size


def _schedule(spark, sf_dir):
    sources = _sources(spark, sf_dir)
    size = _size(sources)
    return blend.schedule(blend.checked(blend.quotas(sources, F.lit(size)))), size


@query
def blend_size(spark, sf_dir):
    return blend.blend_size(_sources(spark, sf_dir))


@query
def blend_quota(spark, sf_dir):
    sources = _sources(spark, sf_dir)
    return blend.checked(blend.quotas(sources, F.lit(_size(sources)))).select("ds", "slug", "n")


@query
def blend_schedule(spark, sf_dir):
    return _schedule(spark, sf_dir)[0]


@query
def blend_schedule_kept(spark, sf_dir):
    """The schedule made once and kept; the second call reads it."""
    sources, folder = _sources(spark, sf_dir), scratch.fresh_path(spark, "blends")
    size = _size(sources)
    blend.cached(sources, size, S, "train", folder)
    return blend.cached(sources, size, S, "train", folder)


@query
def blend_cache_key(spark, sf_dir):
    sources = _sources(spark, sf_dir)
    return blend.cache_key(sources, F.lit(_size(sources)), S, "train")


@query
def rank_shard(spark, sf_dir):
    rows, size = _schedule(spark, sf_dir)
    return blend.rank_shard(rows, F.lit(size), WORLD)


@query
def blend_batches(spark, sf_dir):
    """The flagship: every batch of the blend with its windows."""
    rows, _ = _schedule(spark, sf_dir)
    mix = config.table(spark, BLEND, "ds int, slug string, weight double").select("ds", "slug")
    windows = shards.windows(_tokens(spark, sf_dir, "lang"), S, "train", VAL_FRAC).join(mix, "slug")
    return blend.batches(rows, windows, BATCH).select("batch", "item", "ds", "sample", F.md5(F.hex("x")).alias("x_md5"), F.md5(F.hex("y")).alias("y_md5"))


@query
def resume_position(spark, sf_dir):
    rows = config.table(spark, LEDGER, "completed_steps bigint, train_batches_seen bigint")
    return ledger.resume_position(rows, 1234)


@query
def checkpoint_commits(spark, sf_dir):
    """Entries of a run's checkpoints, each put in place whole; one of them twice."""
    folder, run = scratch.fresh_path(spark, "checkpoints"), config.load_run(RUN)
    for steps, seen in [*LEDGER, LEDGER[-1]]:
        runs.commit(spark, folder, run, steps, seen, 0)
    return runs.entries(spark, folder).select("completed_steps", "train_batches_seen", F.col("config")["d_model"].cast("bigint").alias("d_model"))


@query
def lr_schedule(spark, sf_dir):
    return ledger.lr_schedule(spark, config.load_run(RUN))


@query
def train_calendar(spark, sf_dir):
    return ledger.train_calendar(spark, config.load_run(RUN))


@query
def checkpoint_calendar(spark, sf_dir):
    return ledger.checkpoint_calendar(spark, config.load_run(RUN))


@query
def token_budget_by_run(spark, sf_dir):
    return ledger.token_budget(_runs(spark))


@query
def param_count(spark, sf_dir):
    return ledger.parameters(_runs(spark))


@query
def mean_losses(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("batch"), F.col("value").alias("loss"))
    return ledger.mean_losses(rows, 16).withColumn("loss", F.round("loss", 6))


def _gates(spark):
    return config.table(spark, GATES, "run string, step bigint, loss double")


@query
def step0_gate(spark, sf_dir):
    return ledger.step0_gate(_gates(spark).where("step = 0"), 49_152).withColumn("expected", F.round("expected", 6))


@query
def overfit_gate(spark, sf_dir):
    return ledger.overfit_gate(_gates(spark))


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def _shown(df, *keep):
    """A few values of the array y, and their sum."""
    rounded = lambda v, n: F.when(F.round(v, n) == 0, 0.0).otherwise(F.round(v, n))  # noqa: E731  no negative zero
    at = [rounded(F.element_at("y", k), 6).alias(f"y{k}") for k in (1, 2, 9, 16)]
    return df.select(*keep, *at, rounded(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), 5).alias("y_sum"))


@query
def rmsnorm(spark, sf_dir):
    return _shown(_vectors(spark, sf_dir).withColumn("y", kernels.rmsnorm(F.col("x"))), "vec_id")


@query
def silu(spark, sf_dir):
    return _shown(_vectors(spark, sf_dir).withColumn("y", F.transform("x", kernels.silu)), "vec_id")


@query
def rope_table(spark, sf_dir):
    return kernels.rope_table(spark, 64, 16).select("pos", "i", F.round("cos", 6).alias("cos"), F.round("sin", 6).alias("sin"))


@query
def rope_apply(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("h", F.slice("x", 1, 16))
    return _shown(rows.withColumn("y", kernels.rope(F.col("h"), F.col("vec_id") % 128, 16)), "vec_id")


@query
def causal_softmax(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 16).alias("seq"), F.lit(0).alias("head"), (F.col("vec_id") % 16).alias("pos"), F.col("x").alias("q"), F.col("x").alias("k"), F.col("x").alias("v"))
    return _shown(kernels.causal_attention(rows, 1 / 8).withColumnRenamed("out", "y"), "seq", "pos")


@query
def linear(spark, sf_dir):
    """Every vector times a matrix of the first 16 ones."""
    rows = _vectors(spark, sf_dir)
    matrix = rows.where("vec_id < 16").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda e: e["x"]).alias("w"))  # 16 rows
    return _shown(rows.join(F.broadcast(matrix)).withColumn("y", kernels.linear(F.col("x"), F.col("w"))), "vec_id")


@query
def swiglu(spark, sf_dir):
    """The gated feed-forward of every vector's first 16 numbers; its matrices are of the first 16 vectors."""
    rows = _vectors(spark, sf_dir)
    some = rows.where("vec_id < 16").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda e: F.slice(e["x"], 1, 16)).alias("w"))  # 16 rows
    down = F.transform("w", lambda r: F.slice(r, 1, 8))
    y = kernels.swiglu(F.slice("x", 1, 16), F.slice("w", 1, 8), F.slice("w", 9, 8), down)
    return _shown(rows.join(F.broadcast(some)).withColumn("y", y), "vec_id")


@query
def grouped_attention(spark, sf_dir):
    """Four query heads over two key-value heads of 16 numbers each."""
    rows = _vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 16).alias("seq"), (F.col("vec_id") % 16).alias("pos"), "x")
    part = lambda k: F.slice(F.col("x"), 16 * k + 1, 16)
    q = rows.select("seq", "pos", F.posexplode(F.array(*map(part, range(4)))).alias("head", "q"))
    kv = rows.select("seq", "pos", F.posexplode(F.array(*map(part, range(2)))).alias("kv_head", "k")).withColumn("v", F.col("k"))
    return _shown(kernels.grouped_attention(q, kv, 4, 2, 0.25).withColumnRenamed("out", "y"), "seq", "head", "pos")


@query
def cross_entropy(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("x", F.transform("x", lambda v: v * 10))
    return rows.select("vec_id", F.round(kernels.cross_entropy(F.col("x"), F.col("label")), 6).alias("loss"))


@query
def embedding_lookup(spark, sf_dir):
    tokens = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 200).alias("id"))
    table = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("x").alias("y"))
    return _shown(kernels.embedded(tokens, table), "event_id", "id")


ORACLES = oracles.build(S, VAL_FRAC, BATCH, WORLD, BLEND, TARGETS, BUDGET, BYTE_TARGET, MERGES, RUN, LEDGER, GATES, EOS, PLAN_BUDGETS)
