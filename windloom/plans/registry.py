"""All queries of this package's operators."""

from __future__ import annotations

from importlib import import_module

_MODULES: tuple[str, ...] = ("relational", "sequences", "wake", "forecasts", "texts", "streams", "watch", "followups", "studies", "backtests", "exports")


def _all(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        out |= getattr(import_module(f"windloom.plans.{module}"), name, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
