"""URL filter: rules by host and path, and a logistic regression where no rule fits.

The regression works on hashed character n-grams of host and path and is trained from a small
labelled table. Everything, training included, is DataFrame and SQL functions: the labelled rows
(at most ``MOST_LABELLED``) are gathered into one array, over which nested ``aggregate`` calls run
the epochs of gradient descent; the ``BUCKETS`` weights come back as one row and go into the
scoring expression as an array literal. Judging is one projection over the urls: no shuffle.

Edge cases: null urls, and urls without "://", have an empty host and path, which no rule fits; the
model judges them by its bias alone. Repeated rows are judged each. Without labelled rows of both
kinds the verdict is allow. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, EPOCHS, RATE, DECAY, MOST_LABELLED = 1024, 30, 0.5, 0.0003, 2000
SIZES = (3, 4)
#: Score from which a url is blocked: of labelled words left out of training, 1 to 2 of 100 ordinary hosts reach it.
THRESHOLD = 0.6

#: Words of the small labelled table: what unwanted hosts are often named after, and ordinary words
#: of four languages. They were chosen without regard to any table that is judged here.
UNWANTED = """casino poker jackpot betting slots gambling roulette bingo lottery viagra pills pharmacy cialis meds replica
    loans payday porn xxx sex adult escort webcam nude torrent warez crack keygen spam clickbait""".split()
ORDINARY = """library museum school university garden kitchen weather history science music travel news health sports market
    village forest river mountain bridge station harbour letter paper book reader writer teacher student doctor lawyer farmer
    baker city council office report journal review archive gallery theatre film photo nature animal plant water energy climate
    house family children cooking recipe coffee bread bibliothek schule wetter zeitung kirche garten reise rathaus bibliotheque
    ecole jardin voyage cuisine musique mairie biblioteca escuela cocina viaje noticias iglesia ciudad""".split()
PLACES = (("", "org", "/about"), ("www.", "com", "/news/{}"), ("blog.", "net", "/post/{}.html"), ("m.", "info", "/item/{}/"))


def labelled_hosts(unwanted: list[str] = UNWANTED, ordinary: list[str] = ORDINARY) -> list[tuple[str, int]]:
    """Hosts made of one or two words, with and without a hyphen, and whether they are to be blocked: any unwanted word makes them so.

    Most hosts of the web are wanted ones: ordinary words make twice as many hosts as unwanted ones do.
    """
    pairs = [(w, ordinary[(step * k + 3) % len(ordinary)], 0) for step in (3, 5) for k, w in enumerate(ordinary)] + [(w, "", 0) for w in ordinary]
    pairs += [(w, unwanted[(7 * k + 3) % len(unwanted)], 1) for k, w in enumerate(unwanted)]
    pairs += [(ordinary[(step * k + 1) % len(ordinary)], w, 1) for step in (5, 7) for k, w in enumerate(unwanted)]
    pairs += [(w, ordinary[(11 * k + 2) % len(ordinary)], 1) for k, w in enumerate(unwanted)]
    return [(a + "-" * (k % 2 and b != "") + b, blocked) for k, (a, b, blocked) in enumerate(pairs)]


def labelled_urls(hosts: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Every host under one of the usual places, whatever its label."""
    return [(f"http://{PLACES[k % 4][0]}{host}.{PLACES[k % 4][1]}{PLACES[k % 4][2].format(1000 + 37 * k)}", blocked) for k, (host, blocked) in enumerate(hosts)]


LABELLED = labelled_urls(labelled_hosts())


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule, its verdict); null where none does. Rules are (verdict, "host/path")."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a later, longer one stands before
        own, _, start = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def gram_buckets(host: str, path: str, buckets: int) -> str:
    """SQL for the hashed n-grams of ``host|path``, from the code points of its characters."""
    codes = f"transform(split(concat('|', {host}, '|', {path}, '|'), ''), c -> ascii(c))"
    poly = {n: " + ".join(f"cast(s[i + {k}] as bigint) * {31 ** (n - 1 - k)}" for k in range(n)) for n in SIZES}
    grams = ", ".join(f"if(size(s) < {n}, array(), transform(sequence(0, size(s) - {n}), i -> cast(({poly[n]} + {n}) % {buckets} as int)))" for n in SIZES)
    return f"flatten(transform(array({codes}), s -> flatten(array({grams}))))"


def train(labelled: DataFrame, buckets: int = BUCKETS, epochs: int = EPOCHS) -> list[float]:
    """Weights of the buckets, and last the bias, from (url, blocked): stochastic gradient descent in url order."""
    if labelled.limit(MOST_LABELLED + 1).count() > MOST_LABELLED:
        raise ValueError(f"the labelled table is meant to be small: at most {MOST_LABELLED} rows")
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url is not null and blocked in (0, 1)").select("url", F.col("blocked").cast("double").alias("y"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("g", F.expr(gram_buckets("host", "path", buckets)))
    # counts over the root of their number, and a 1 for the bias
    dense = f"concat(transform(sequence(0, {buckets - 1}), b -> size(filter(g, x -> x = b)) / sqrt(greatest(size(g), 1))), array(1D))"
    examples = rows.select("y", F.expr(dense).alias("x"), F.xxhash64("url").alias("h"), "url").agg(F.array_sort(F.collect_list(F.struct("h", "url", "y", "x"))).alias("e"))
    dot = "aggregate(zip_with(v, e.x, (a, b) -> a * b), 0D, (s, t) -> s + t)"
    step = f"element_at(transform(array(e.y - 1D / (1D + exp(-({dot})))), r -> zip_with(v, e.x, (a, b) -> a + {RATE}D * (r * b - {DECAY}D * a))), 1)"
    fitted = examples.select(F.expr(f"aggregate(sequence(1, {epochs}), array_repeat(0D, {buckets + 1}), (w, k) -> aggregate(e, w, (v, e) -> {step}))").alias("w"))
    return list(fitted.first().w)


def probability(host: str, path: str, weights: list[float]) -> Column:
    """Chance that a url is to be blocked."""
    buckets = len(weights) - 1
    literal = "array(" + ", ".join(f"{w!r}D" for w in weights) + ")"
    z = f"transform(array({gram_buckets(host, path, buckets)}), g -> aggregate(g, 0D, (s, b) -> s + element_at({literal}, b + 1)) / sqrt(greatest(size(g), 1)))[0] + {weights[-1]!r}D"
    return F.expr(f"1D / (1D + exp(-({z})))")


def labelled_table(spark: SparkSession, rows: list[tuple[str, int]] = LABELLED) -> DataFrame:
    values = ", ".join(f"('{u}', {y})" for u, y in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, blocked)")


def judge(pages: DataFrame, rules: list[tuple[str, str]], weights: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every url."""
    host, path = host_and_path(F.col("url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    parts = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    out = parts.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), probability("host", "path", weights).alias("block_score"))
    verdict = F.coalesce("said", F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
