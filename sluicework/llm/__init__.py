"""Operations of a large training-data pipeline. Nothing else in the library imports this."""

from __future__ import annotations

from . import oracles as _oracles
from . import queries as _queries


def queries() -> dict:
    return {k: getattr(_queries, k) for k in sorted((k for k in vars(_queries) if k.startswith("op") and k[2].isdigit()), key=lambda k: int(k[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    """Of those queries that SQL can express; the others are tested by brute force in tests/llm."""
    return {
        "op6_url_ngram_model": _oracles.url_sql(_queries.URL_RULES, _oracles.url_weights()),
        "op7_minmax_near_duplicates": _oracles.NEAR_DUPLICATES,
    }
