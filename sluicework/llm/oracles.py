"""SQL for DuckDB with the rows of those queries that SQL can express."""

from __future__ import annotations

import math

from .url_model import BUCKETS, DECAY, EPOCHS, LABELLED, RATE, SIZES, THRESHOLD

#: Near duplicates in full: shared shingles of every pair, then what is reachable.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 4 THEN [array_to_string(a, ' ')] ELSE list_distinct(list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i + 3], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u AS d, u AS m FROM e UNION SELECT r.d, e.v FROM r JOIN e ON r.m = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT d, min(m) AS m FROM r GROUP BY d) c ON c.d = d.doc_id
"""


def grams_of(host: str, path: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the n-grams of host and path, n by n."""
    codes = [ord(c) for c in f"|{host}|{path}|"]
    return [(sum(c * 31 ** (n - 1 - k) for k, c in enumerate(codes[i : i + n])) + n) % buckets for n in SIZES for i in range(len(codes) - n + 1)]


def split_url(url: str | None) -> tuple[str, str]:
    rest = url.partition("://")[2] if url and "://" in url else ""
    k = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host = rest[:k].translate({c: c + 32 for c in range(65, 91)})
    path = rest[k:]
    return host, path[: next((k for k, c in enumerate(path) if c in "?#"), len(path))]


def url_weights(labelled: list[tuple[str, int]] = LABELLED, buckets: int = BUCKETS, epochs: int = EPOCHS) -> list[float]:
    """The model's weights by plain loops, number for number as the query makes them."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = []
    for url, y in labelled:
        g = grams_of(*split_url(url), buckets)
        x = [0.0] * buckets
        for b in g:
            x[b] += 1
        rows.append((signed(xxhash.xxh64_intdigest(url.encode(), seed=42)), float(y), [v / math.sqrt(max(len(g), 1)) for v in x] + [1.0]))
    w = [0.0] * (buckets + 1)
    for _ in range(epochs):
        for _, y, x in sorted(rows, key=lambda r: r[0]):
            z = 0.0
            for a, b in zip(w, x):
                z += a * b
            r = y - 1.0 / (1.0 + math.exp(-z))
            w = [a + RATE * (r * b - DECAY * a) for a, b in zip(w, x)]
    return w


def url_sql(rules: list[tuple[str, str]], weights: list[float]) -> str:
    values = ", ".join(f"('{what}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for what, rule in rules)
    grams = " || ".join(f"(CASE WHEN len(s) < {n} THEN [] ELSE list_transform(range(1, len(s) - {n} + 2), lambda i: (" + " + ".join(f"s[i + {k}] * {31 ** (n - 1 - k)}" for k in range(n)) + f" + {n}) % {len(weights) - 1}) END)" for n in SIZES)
    return f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
    p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
    rules AS (SELECT * FROM (VALUES {values}) AS t(verdict, rule, own, start)),
    fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rules.verdict, length(rule)) AS said FROM p JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY page_id),
    c AS (SELECT *, list_transform(string_split('|' || host || '|' || path || '|', ''), lambda x: CAST(unicode(x) AS BIGINT)) AS s FROM p),
    g AS (SELECT page_id, host, path, {grams} AS g FROM c),
    z AS (SELECT page_id, host, path, list_sum(list_transform(g, lambda b: {weights[:-1]!r}[b + 1])) / sqrt(greatest(len(g), 1)) + {weights[-1]!r} AS z FROM g)
    SELECT page_id, host, path, rule, coalesce(said, CASE WHEN 1 / (1 + exp(-z)) >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, round(1 / (1 + exp(-z)), 6) AS block_score FROM z LEFT JOIN fit USING (page_id)"""
