"""Queries over the given tables, and their SQL."""

from __future__ import annotations

import importlib

_MODULES = ["events", "boundaries", "pauses", "reports", "bars", "signals", "adaptation", "rhythm", "finals", "spectral", "strategies", "profiles", "exchange"]


def _all(name: str) -> dict:
    return {k: v for m in _MODULES for k, v in getattr(importlib.import_module(f"{__name__}.{m}"), name).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
