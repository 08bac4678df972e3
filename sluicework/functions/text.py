"""Scalar expressions over texts, labels and packed token ids. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EOS_HEX, PRE_TOKEN_JAVA, SPECIAL_SPLIT


def nonempty(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def source_label(repo_id: Column, config: Column, data_dir: Column) -> Column:
    """repo/config, repo/data_dir or repo; config goes first."""
    return F.concat_ws("/", repo_id, F.coalesce(F.nullif(config, F.lit("")), F.nullif(data_dir, F.lit(""))))


def source_slug(repo_id: Column, config: Column) -> Column:
    """Last part of the repo's name, and the config where one is set."""
    return F.concat_ws("-", F.element_at(F.split(repo_id, "/"), -1), F.nullif(config, F.lit("")))


def json_line_bytes(text: Column) -> Column:
    """Bytes of the JSONL line {"text": ...} and its line break."""
    return (F.octet_length(F.to_json(F.struct(text.alias("text")))) + 1).cast("bigint")


def pre_tokens(text: Column) -> Column:
    """Pre-tokens of a text, special tokens as separators."""
    return F.flatten(F.transform(F.split(text, SPECIAL_SPLIT), lambda t: F.regexp_extract_all(t, F.lit(PRE_TOKEN_JAVA), F.lit(0))))


def byte_string(text: Column) -> Column:
    """UTF-8 bytes of a text as a string that has a character of that number for each byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes of a text as array<int>: the ids of a tokenizer without merges."""
    s = byte_string(text)
    return F.when(F.length(s) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(s, ""), F.ascii))


def packed_bytes(text: Column) -> Column:
    """The text's bytes and EOS as little-endian 16-bit ids."""
    return F.unhex(F.concat(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$100"), F.lit(EOS_HEX)))


def packed(ids: Column) -> Column:
    """array<int> under 65,536 as little-endian 16-bit ids."""
    one = lambda t: F.concat(F.lpad(F.hex(t.cast("bigint") % 256), 2, "0"), F.lpad(F.hex(F.floor(t / 256)), 2, "0"))
    return F.unhex(F.array_join(F.transform(ids, one), ""))


def unpacked(data: Column) -> Column:
    """Little-endian 16-bit ids as array<int>."""
    h = F.hex(data)
    return F.when(F.length(h) < 4, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.length(h) / 4 - 1, F.lit(0)).cast("int")), lambda k: F.conv(F.concat(F.substring(h, k * 4 + 3, F.lit(2)), F.substring(h, k * 4 + 1, F.lit(2))), 16, 10).cast("int")))


def words(text: Column) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))
