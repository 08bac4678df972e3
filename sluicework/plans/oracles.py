"""The registered queries once more, as SQL for DuckDB."""

from __future__ import annotations

from dataclasses import asdict

from .. import config
from ..constants import printable_bytes

RUN_COLUMNS = "vocab_size seq_len n_layers d_model d_ff n_heads n_kv_heads head_dim n_steps batch_size grad_accum_steps".split()


def run_table() -> tuple[list[tuple], str]:
    rows = [(name, *(asdict(config.load_run(name))[c] for c in RUN_COLUMNS)) for name in config.RUNS]
    return rows, "run string, " + ", ".join(f"{c} int" for c in RUN_COLUMNS)


def default_rows() -> list[tuple[str, str]]:
    return [(k, str(v)) for k, v in asdict(config.RunConfig()).items()]


def _values(rows: list[tuple], schema: str) -> str:
    kinds = {"string": "VARCHAR", "int": "INTEGER"}
    return config.values(rows, ", ".join(f"{n} {kinds.get(t, t)}" for n, t in (x.split() for x in schema.split(", "))))


def build(s, val_frac, batch, world, blend, targets, budget, byte_target, merges, run, ledger, gates, eos, plan_budgets) -> dict[str, str]:
    mix = f"mixes AS ({_values(config.mix_rows(), config.MIX_SCHEMA)})"
    plan = f"plan AS ({_values(config.plan_rows(), config.PLAN_SCHEMA)})"
    slug = "list_extract(string_split(repo_id, '/'), -1) || coalesce('-' || nullif(config, ''), '')"
    kv = "key string, value string"
    own = [(k, str(v)) for k, v in config.RUNS[run].items()]
    one, two = config.setting_rows("run_124m"), config.setting_rows(run)
    r = config.load_run(run)
    eos_hex = eos.to_bytes(2, "little").hex().upper()
    full = "sum(seq_len) OVER (PARTITION BY slug{part} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def tokens(by: str) -> str:
        return f"""tok AS (SELECT {by} AS slug, doc_id, CAST(strlen(text) + 1 AS BIGINT) AS seq_len, regexp_replace(hex(text), '(..)', '\\100', 'g') || '{eos_hex}' AS hx FROM documents),
        idx AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id) - 1 AS doc_seq, CAST(coalesce({full.format(part="")}, 0) AS BIGINT) AS st FROM tok),
        tot AS (SELECT slug, count(*) AS n_docs, CAST(sum(seq_len) AS BIGINT) AS n_tokens FROM tok GROUP BY slug),
        cuts AS (SELECT *, (n_tokens - CAST(floor(n_tokens * CAST({val_frac} AS DOUBLE)) AS BIGINT)) // {s} * {s} AS cut FROM tot),
        bnd AS (SELECT *, greatest(0, (cut - 1) // {s}) AS n_train, greatest(0, (n_tokens - cut - 1) // {s}) AS n_val FROM cuts)"""

    def windows(start: str, n: str) -> str:
        return f"""streams AS (SELECT slug, string_agg(hx, '' ORDER BY doc_id) AS f FROM tok GROUP BY slug),
        win AS (SELECT slug, k, substr(f, ({start} + k * {s}) * 4 + 1, {s} * 4) AS x, substr(f, ({start} + k * {s} + 1) * 4 + 1, {s} * 4) AS y FROM streams JOIN bnd USING (slug), LATERAL (SELECT unnest(range({n})) AS k))"""

    blended = f"""{tokens("lang")}, mix AS ({_values(blend, "ds int, slug string, weight double")}),
        src AS (SELECT ds, slug, weight / (SELECT sum(weight) FROM mix) AS w, n_train AS n_samples FROM mix JOIN bnd USING (slug)),
        sz AS (SELECT CAST(floor(min(n_samples / w)) AS BIGINT) AS size FROM src WHERE w > 0),
        raw AS (SELECT *, w * size AS raw, CAST(floor(w * size) AS BIGINT) AS fl FROM src, sz),
        quo AS (SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY raw - fl DESC, ds) <= size - (SELECT sum(fl) FROM raw) THEN 1 ELSE 0 END AS n FROM raw),
        sch AS (SELECT row_number() OVER (ORDER BY (sample + 0.5::DOUBLE) / w, ds, sample) - 1 AS pos, ds, sample FROM quo, LATERAL (SELECT unnest(range(n)) AS sample))"""
    first = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 2000)"
    avg = "CAST(coalesce(sum(strlen(text)) FILTER (WHERE text <> '') / nullif(count(*) FILTER (WHERE text <> ''), 0), 0) AS DOUBLE)"
    shares = f"""{first.format(g="lang")}, av AS (SELECT lang, {avg} AS avg_bytes FROM first GROUP BY lang), tg AS ({_values(targets, "ord int, lang string, target double")}),
        rw AS (SELECT *, CASE WHEN avg_bytes > 0 THEN target / avg_bytes ELSE 0 END AS r FROM tg JOIN av USING (lang)), sh AS (SELECT lang, ord, avg_bytes, round(r / (SELECT sum(r) FROM rw), 6) AS p FROM rw)"""
    line = "CAST(strlen(CAST(json_object('text', text) AS VARCHAR)) + 1 AS BIGINT)"
    # the look-ahead of the last alternatives can't be said here; the tables have no run of white space that needs it
    up, low = "[\\p{Lu}\\p{Lt}\\p{Lm}\\p{Lo}\\p{M}]", "[\\p{Ll}\\p{Lm}\\p{Lo}\\p{M}]"
    lead, short = "[^\\r\\n\\p{L}\\p{N}]?", "(?i:''s|''t|''re|''ve|''m|''ll|''d)?"
    pattern = f"{lead}{up}*{low}+{short}|{lead}{up}+{low}*{short}|\\p{{N}}{{1,3}}| ?[^\\s\\p{{L}}\\p{{N}}]+[\\r\\n/]*|\\s*[\\r\\n]+|\\s+"
    freq = f"freq AS (SELECT tok, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '{pattern}')) AS tok FROM documents) GROUP BY tok)"
    # bytes of a pre-token as |a||b|: two hex digits each, turned into numbers
    seq0 = "seq0 AS (SELECT tok, cnt, list_aggregate(list_transform(range(1, CAST(strlen(tok) AS BIGINT) + 1), lambda k: '|' || CAST(('0x' || substr(hex(tok), 2 * k - 1, 2)) AS INTEGER) || '|'), 'string_agg', '') AS sq FROM freq)"

    def pairs(k: int) -> str:
        ids = f"ids{k} AS (SELECT cnt, CAST(string_split(trim(sq, '|'), '||') AS INTEGER[]) AS a FROM seq{k})"
        return f"{ids}, pr{k} AS (SELECT a[i] AS l, a[i + 1] AS r, CAST(sum(cnt) AS BIGINT) AS n FROM ids{k}, LATERAL (SELECT unnest(range(1, len(a))) AS i) GROUP BY 1, 2)"

    def chain(n: int) -> str:
        out = [freq, seq0]
        for k in range(n):
            out.append(f"{pairs(k)}, top{k} AS (SELECT * FROM pr{k} ORDER BY n DESC, l, r LIMIT 1)")
            out.append(f"seq{k + 1} AS (SELECT tok, cnt, replace(sq, '|' || (SELECT l FROM top{k}) || '||' || (SELECT r FROM top{k}) || '|', '|{256 + k}|') AS sq FROM seq{k})")
        return ", ".join(out)

    encoded = f"{chain(merges)}, sums AS (SELECT tok, CAST(string_split(trim(sq, '|'), '||') AS INTEGER[]) AS a FROM seq{merges}), per AS (SELECT tok, len(a) AS n, list_sum(a) AS s FROM sums), each AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS tok FROM documents), enc AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(s) AS BIGINT) AS id_sum FROM each JOIN per USING (tok) GROUP BY doc_id)"
    bytes_ = ", ".join(f"({b}, {ord(c)})" for b, c in printable_bytes().items())
    runs = f"runs AS ({_values(*run_table())})"
    steps = f"st AS (SELECT unnest(range({r.n_steps})) AS step)"
    gate = f"g AS ({_values(gates, 'run string, step bigint, loss double')})"
    vec = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"

    def shown(expr: str, keep: str, source: str) -> str:
        rounded = lambda v, n: f"CASE WHEN round({v}, {n}) = 0 THEN 0::DOUBLE ELSE round({v}, {n}) END"
        at = ", ".join(f"{rounded(f'y[{k}]', 6)} AS y{k}" for k in (1, 2, 9, 16))
        return f"SELECT {keep}, {at}, {rounded('list_sum(y)', 5)} AS y_sum FROM (SELECT {keep}, {expr} AS y FROM {source})"

    angle = "({pos}) / pow(10000::DOUBLE, 2.0::DOUBLE * (({i}) % 8) / 16)"
    a = angle.format(pos="(vec_id % 128)", i="i")
    out = {
        "scan_project_text": "SELECT page_id, html AS text FROM pages",
        "nonempty_filter": "SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''",
        "blob_lookup_default": "SELECT doc_id, lang, coalesce(body, '') AS text FROM documents LEFT JOIN (SELECT conv_id, min(text) AS body FROM conversations WHERE turn = 0 GROUP BY conv_id) ON doc_id = conv_id",
        "blob_gunzip": "SELECT doc_id, md5(CASE WHEN doc_id % 3 <> 0 THEN text ELSE '' END) AS text_md5, doc_id % 3 <> 0 AND text <> '' AS fetched FROM documents",
        "blob_fetch": "SELECT doc_id, 'content/' || doc_id AS text FROM documents",
        "file_subset": "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id % 3 <> 1",
        "corpus_jsonl_roundtrip": "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1",
        "pinned_read": "SELECT doc_id, n_chars FROM documents",
        "skip_rows": "SELECT doc_id, n_chars FROM documents ORDER BY doc_id OFFSET 100",
        "source_slug": f"WITH {mix} SELECT mix, ord, repo_id, config, {slug} AS slug FROM mixes",
        "source_label": f"WITH {mix} SELECT mix, ord, repo_id, config, data_dir, repo_id || coalesce('/' || coalesce(nullif(config, ''), nullif(data_dir, '')), '') AS label FROM mixes",
        "plan_filter_category": f"WITH {plan} SELECT {slug} AS slug, category, tokens FROM plan WHERE category = 'code'",
        "config_resolve": f"WITH d AS ({_values(default_rows(), kv)}), o AS ({_values(own, kv)}) SELECT d.key, coalesce(o.value, d.value) AS value FROM d LEFT JOIN o ON d.key = o.key",
        "resume_config_diff": f"WITH a AS ({_values(one, kv)}), b AS ({_values(two, kv)}) SELECT key, a.value AS saved, b.value AS current FROM a FULL JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value AND key NOT IN ('device', 'checkpoint_dir')",
        "unknown_config_keys": f"WITH d AS ({_values(default_rows(), kv)}) SELECT key FROM (VALUES ('lr'), ('learning_rate'), ('n_layer')) AS g(key) WHERE key NOT IN (SELECT key FROM d)",
        "mix_missing_shards": f"WITH {mix}, {plan} SELECT DISTINCT {slug} AS slug FROM mixes WHERE mix = 'flagship' AND {slug} NOT IN (SELECT {slug} FROM plan)",
        "avg_doc_bytes": f"WITH {first.format(g='source')} SELECT source, round({avg}, 6) AS avg_bytes FROM first GROUP BY source",
        "byte_weighted_probs": f"WITH {shares} SELECT lang, round(avg_bytes, 6) AS avg_bytes, p FROM sh",
        "corpus_byte_cut": f"WITH l AS (SELECT doc_id, {line} AS line_bytes FROM documents WHERE text <> ''), b AS (SELECT *, CAST(coalesce(sum(line_bytes) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM l) SELECT * FROM b WHERE before < {byte_target}",
        "tokenizer_corpus": f"""WITH {shares}, own AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents),
            ns AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT lang, ord, p, n, (SELECT max(n / p) FROM ns JOIN sh USING (lang) WHERE p > 0) AS stop FROM ns JOIN sh USING (lang) WHERE p > 0),
            m AS (SELECT lang, ord, p, n, CAST(floor(p * stop + 0.5) AS BIGINT) AS m FROM e),
            d AS (SELECT doc_id, lang, text, ord, q * n + k AS j, (q * n + k + 0.5::DOUBLE) / p AS t FROM own JOIN m USING (lang), LATERAL (SELECT unnest(range((m - k - 1) // n + 1)) AS q) WHERE k < m),
            l AS (SELECT doc_id, lang, j, t, ord, {line} AS line_bytes FROM d WHERE text <> ''),
            b AS (SELECT doc_id, lang, j, line_bytes, CAST(coalesce(sum(line_bytes) OVER (ORDER BY t, ord, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM l)
            SELECT * FROM b WHERE before < {byte_target}""",
        "pretoken_freq": f"WITH {freq} SELECT tok, cnt FROM freq",
        "byte_pair_freq": f"WITH {freq}, {seq0}, {pairs(0)} SELECT l, r, n FROM pr0",
        "bpe_first_merge": f"WITH {chain(1)} SELECT l, r, n FROM top0",
        "bpe_train_k": f"WITH {chain(merges)} " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS rank, l, r, n FROM top{k}" for k in range(merges)),
        "encode_tokens": f"WITH {encoded} SELECT doc_id, n_tokens, id_sum FROM enc",
        "decode_roundtrip": "SELECT doc_id, TRUE AS ok FROM documents",
        "vocabulary_files": f"WITH {chain(merges)} " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS rank, l, r FROM top{k}" for k in range(merges)),
        "bpe_train_on_cluster": f"WITH {chain(merges)} " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS rank, l, r, n FROM top{k}" for k in range(merges)),
        "tokenizer_report": f"""WITH {encoded}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 20 AND text <> '')
            SELECT source, round(sum(strlen(text)) / CAST(sum(n_tokens) AS DOUBLE), 6) AS bytes_per_token, round(sum(length(text)) / CAST(sum(n_tokens) AS DOUBLE), 6) AS chars_per_token, round(sum(n_tokens) / CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS DOUBLE), 6) AS fertility FROM f JOIN enc USING (doc_id) GROUP BY source""",
        "byte_alphabet": f"SELECT CAST(b AS INTEGER) AS byte, CAST(c AS INTEGER) AS cp FROM (VALUES {bytes_}) AS t(b, c)",
        "tokenizer_metrics": "SELECT source, round(sum(strlen(text)) / CAST(sum(strlen(text)) AS DOUBLE), 6) AS bytes_per_token, round(sum(length(text)) / CAST(sum(strlen(text)) AS DOUBLE), 6) AS chars_per_token, round(sum(strlen(text)) / CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS DOUBLE), 6) AS fertility FROM documents WHERE text <> '' GROUP BY source",
        "shard_index": f"WITH {tokens('source')} SELECT slug, doc_seq, seq_len, st * 2 AS ptr FROM idx",
        "shard_totals": f"WITH {tokens('source')} SELECT slug, n_docs, n_tokens FROM tot",
        "shard_file_roundtrip": f"WITH {tokens('source')} SELECT slug, n_docs, n_tokens FROM tot",
        "shard_get_document": f"WITH {tokens('source')} SELECT slug, doc_seq, seq_len, md5(hx) AS ids_md5 FROM idx WHERE slug = 'src3' AND doc_seq = 7",
        "shard_get_span": f"WITH {tokens('source')} SELECT slug, md5(substr(string_agg(hx, '' ORDER BY doc_id), 4001, 20000)) AS ids_md5 FROM tok WHERE slug = 'src3' GROUP BY slug",
        "shard_file_documents": f"WITH {tokens('source')} SELECT slug, doc_seq, md5(hx) AS ids_md5 FROM idx WHERE doc_seq = 7",
        "shard_file_spans": f"WITH {tokens('source')} SELECT slug, CAST(1000 AS BIGINT) AS start, md5(substr(string_agg(hx, '' ORDER BY doc_id), 4001, 8000)) AS ids_md5 FROM tok GROUP BY slug",
        "shard_file_lengths": f"WITH {tokens('source')} SELECT slug, count(*) AS n_docs, CAST(sum(seq_len) AS BIGINT) AS n_tokens, max(seq_len) AS longest FROM tok GROUP BY slug",
        "shard_merged_parts": f"WITH {tokens('source')} SELECT slug, n_docs, n_tokens, CAST(0 AS BIGINT) AS last_part FROM tot",
        "plan_bpe_shards": f"""WITH {encoded}, p AS ({_values(plan_budgets, "slug string, budget bigint")}), t AS (SELECT lang AS slug, d.doc_id, coalesce(n_tokens, 0) + 1 AS seq_len, coalesce(id_sum, 0) + {eos} AS s FROM documents d LEFT JOIN enc ON enc.doc_id = d.doc_id WHERE text IS NOT NULL),
            b AS (SELECT *, coalesce(sum(seq_len) OVER (PARTITION BY slug ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
            SELECT slug, count(*) AS n_docs, CAST(sum(seq_len) AS BIGINT) AS n_tokens, CAST(sum(s) AS BIGINT) AS id_sum FROM b JOIN p USING (slug) WHERE before <= budget GROUP BY slug""",
        "token_budget_cut": f"WITH {tokens('source')} SELECT slug, count(*) AS n_docs, CAST(sum(seq_len) AS BIGINT) AS n_tokens FROM idx WHERE st <= {budget} GROUP BY slug",
        "streaming_token_budget": f"WITH {tokens('source')} SELECT slug, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(seq_len) AS BIGINT) AS n_tokens FROM idx WHERE st <= {budget} GROUP BY slug",
        "streaming_restarts": f"WITH {tokens('source')} SELECT slug, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(seq_len) AS BIGINT) AS n_tokens FROM idx WHERE st <= {budget} GROUP BY slug",
        "token_budget_cut_parallel": f"WITH {tokens('source')}, p AS (SELECT *, doc_seq % 4 AS part FROM idx), b AS (SELECT *, coalesce({full.format(part=', part')}, 0) AS before FROM p) SELECT slug, part, count(*) AS n_docs, CAST(sum(seq_len) AS BIGINT) AS n_tokens FROM b WHERE before <= {budget // 4} GROUP BY slug, part",
        "split_bounds": f"WITH {tokens('source')} SELECT slug, cut, n_train, n_val FROM bnd",
        "token_windows": f"WITH {tokens('source')}, {windows('0', 'n_train')} SELECT slug, k, md5(x) AS x_md5, md5(y) AS y_md5 FROM win",
        "token_windows_val": f"WITH {tokens('source')}, {windows('cut', 'n_val')} SELECT slug, k, md5(x) AS x_md5, md5(y) AS y_md5 FROM win",
        "blend_size": f"WITH {blended} SELECT size FROM sz",
        "blend_quota": f"WITH {blended} SELECT ds, slug, n FROM quo",
        "blend_schedule": f"WITH {blended} SELECT pos, ds, sample FROM sch",
        "blend_schedule_kept": f"WITH {blended} SELECT pos, ds, sample FROM sch",
        "blend_cache_key": f"WITH {blended} SELECT substr(md5(string_agg(slug, ',' ORDER BY ds) || '|' || string_agg(printf('%.6f', w), ',' ORDER BY ds) || '|' || (SELECT size FROM sz) || '|' || string_agg('{s}:train:' || n_samples, ',' ORDER BY ds)), 1, 12) AS key FROM src",
        "rank_shard": f"WITH {blended} SELECT pos % {world} AS rank, pos // {world} AS idx, ds, sample FROM sch WHERE pos < (SELECT size FROM sz) // {world} * {world}",
        "blend_batches": f"WITH {blended}, {windows('0', 'n_train')} SELECT pos // {batch} AS batch, pos % {batch} AS item, sch.ds, sample, md5(x) AS x_md5, md5(y) AS y_md5 FROM sch JOIN mix ON sch.ds = mix.ds JOIN win ON win.slug = mix.slug AND win.k = sample",
        "resume_position": f"WITH l AS ({_values(ledger, 'completed_steps bigint, train_batches_seen bigint')}) SELECT completed_steps, train_batches_seen % 1234 AS start_batch, train_batches_seen // 1234 AS passes FROM l",
        "checkpoint_commits": f"WITH l AS ({_values(ledger, 'completed_steps bigint, train_batches_seen bigint')}) SELECT completed_steps, train_batches_seen, CAST({r.d_model} AS BIGINT) AS d_model FROM l",
        "lr_schedule": f"WITH {steps} SELECT step, CASE WHEN step < {r.warmup_steps} THEN step / {r.warmup_steps}::DOUBLE WHEN step < {r.n_steps} * 0.9::DOUBLE THEN 1.0::DOUBLE ELSE ({r.n_steps} - step) / ({r.n_steps} * 0.1::DOUBLE) END AS factor FROM st",
        "train_calendar": f"WITH {steps} SELECT step, step * {r.grad_accum_steps} AS first_batch, step * {r.grad_accum_steps} + {r.grad_accum_steps - 1} AS last_batch, step > 0 AND step % 500 = 0 AS evaluates, (step + 1) % {r.checkpoint_every} = 0 OR step = {r.n_steps - 1} AS saves FROM st",
        "checkpoint_calendar": f"WITH {steps} SELECT step + 1 AS completed_steps, (step + 1) * {r.grad_accum_steps} AS train_batches_seen, step // 500 * {r.n_val_batches} AS val_batches_seen FROM st WHERE (step + 1) % {r.checkpoint_every} = 0 OR step = {r.n_steps - 1}",
        "token_budget_by_run": f"WITH {runs} SELECT run, batch_size::BIGINT * grad_accum_steps * seq_len AS tokens_per_step, batch_size::BIGINT * grad_accum_steps * seq_len * n_steps AS tokens FROM runs",
        "param_count": f"WITH {runs} SELECT run, vocab_size::BIGINT * d_model + n_layers::BIGINT * (2 * n_heads * head_dim * d_model + 2 * n_kv_heads * head_dim * d_model + 3 * d_ff * d_model + 2 * d_model) + d_model AS n_params FROM runs",
        "mean_losses": "SELECT event_id // 16 AS step, round(avg(value), 6) AS loss FROM events GROUP BY 1",
        "step0_gate": f"WITH {gate} SELECT run, loss, round(ln(49152), 6) AS expected, abs(loss - ln(49152)) < 0.2 AS passed FROM g WHERE step = 0",
        "overfit_gate": f"WITH {gate} SELECT run, arg_max(loss, step) AS loss, arg_max(loss, step) < 0.1 AS passed FROM g GROUP BY run",
        "rmsnorm": f"WITH {vec}, r AS (SELECT *, sqrt(list_sum(list_transform(x, lambda e: e * e)) / len(x) + 1e-6) AS rms FROM v) " + shown("list_transform(x, lambda e: e / rms)", "vec_id", "r"),
        "silu": f"WITH {vec} " + shown("list_transform(x, lambda e: e / (1 + exp(-e)))", "vec_id", "v"),
        "rope_table": f"SELECT pos, CAST(i AS INTEGER) AS i, round(cos({angle.format(pos='pos', i='i')}), 6) AS cos, round(sin({angle.format(pos='pos', i='i')}), 6) AS sin FROM (SELECT unnest(range(64)) AS pos), (SELECT unnest(range(16)) AS i)",
        "rope_apply": f"WITH {vec} " + shown(f"list_transform(range(16), lambda i: x[i + 1] * cos({a}) + (CASE WHEN i < 8 THEN -x[i + 9] ELSE x[i - 7] END) * sin({a}))", "vec_id", "v"),
        "causal_softmax": f"""WITH {vec}, p AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS pos, x FROM v),
            sc AS (SELECT a.seq, a.pos, b.pos AS j, b.x AS val, list_dot_product(a.x, b.x) / 8 AS s FROM p a JOIN p b ON a.seq = b.seq AND b.pos <= a.pos),
            w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, pos)) AS e FROM sc), n AS (SELECT *, e / sum(e) OVER (PARTITION BY seq, pos) AS wt FROM w),
            o AS (SELECT seq, pos, k, sum(wt * val[k]) AS u FROM n, LATERAL (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2, 3), g AS (SELECT seq, pos, list(u ORDER BY k) AS yy FROM o GROUP BY 1, 2) """ + shown("yy", "seq, pos", "g"),
        "linear": f"WITH {vec}, m AS (SELECT list(x ORDER BY vec_id) AS w FROM v WHERE vec_id < 16) " + shown("list_transform(w, lambda r: list_dot_product(r, x))", "vec_id", "v, m"),
        "swiglu": f"WITH {vec}, m AS (SELECT list(x[1:16] ORDER BY vec_id) AS w FROM v WHERE vec_id < 16), a AS (SELECT vec_id, w, list_transform(w[9:16], lambda r: list_dot_product(r, x[1:16])) AS up, list_transform(w[1:8], lambda r: list_dot_product(r, x[1:16])) AS gate FROM v, m), c AS (SELECT vec_id, w, list_transform(range(1, 9), lambda i: up[i] * gate[i] / (1 + exp(-gate[i]))) AS h FROM a) " + shown("list_transform(w, lambda r: list_dot_product(r[1:8], h))", "vec_id", "c"),
        "grouped_attention": f"""WITH {vec}, p AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS pos, x FROM v),
            q AS (SELECT seq, pos, CAST(h AS INTEGER) AS head, x[16 * h + 1:16 * h + 16] AS q FROM p, (SELECT unnest(range(4)) AS h)), kv AS (SELECT seq, pos AS j, g, x[16 * g + 1:16 * g + 16] AS val FROM p, (SELECT unnest(range(2)) AS g)),
            sc AS (SELECT q.seq, head, pos, j, val, list_dot_product(q, val) / 4 AS s FROM q JOIN kv ON q.seq = kv.seq AND g = head // 2 AND j <= pos),
            w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, head, pos)) AS e FROM sc), n AS (SELECT *, e / sum(e) OVER (PARTITION BY seq, head, pos) AS wt FROM w),
            o AS (SELECT seq, head, pos, k, sum(wt * val[k]) AS u FROM n, LATERAL (SELECT unnest(range(1, 17)) AS k) GROUP BY 1, 2, 3, 4), g AS (SELECT seq, head, pos, list(u ORDER BY k) AS yy FROM o GROUP BY 1, 2, 3) """ + shown("yy", "seq, head, pos", "g"),
        "cross_entropy": f"WITH {vec}, m AS (SELECT vec_id, label, list_transform(x, lambda e: e * 10) AS z FROM v), t AS (SELECT *, list_max(z) AS top FROM m) SELECT vec_id, round(ln(list_sum(list_transform(z, lambda e: exp(e - top)))) + top - z[label + 1], 6) AS loss FROM t",
        "embedding_lookup": f"WITH {vec} " + shown("x", "event_id, id", "(SELECT event_id, event_id % 200 AS id FROM events) JOIN v ON id = vec_id"),
    }
    return out
