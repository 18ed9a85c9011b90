"""All operators' queries and oracle SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("tokens", "simhash", "quality", "sharding", "embeddings", "bpe", "urls", "toxicity", "media", "packing", "resampling", "divergence", "bestfit")


def _all(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        out |= getattr(import_module(f"windloom.llm.{module}"), name, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
