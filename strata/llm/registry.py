"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality_rules", "order_minhash", "unigram_count", "cutting_stock", "toxicity", "matroska", "substring_dedup", "external_shuffle", "piece_bpe", "bloom_cascade")


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
