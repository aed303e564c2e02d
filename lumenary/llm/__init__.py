"""Operators for large training corpora: duplicates, toxicity, tokens, secrets, licences, contamination, quality, shards, search, clusters."""

from __future__ import annotations


def queries() -> dict:
    from .entries import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .entries import ORACLES

    return dict(ORACLES)
