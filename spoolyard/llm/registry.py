"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, chat_format, exact_dedup, html_text, licenses, lines, mixing, near_dedup, quality, toxicity

MODULES = (lines, licenses, mixing, quality, bpe, html_text, near_dedup, exact_dedup, chat_format, toxicity)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
