"""All registered queries."""

from __future__ import annotations

import importlib

from obsweave.plans import registry

_MODULES = ["observing", "relating", "profiling", "retrieving", "deciding", "scoring", "filing"]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"obsweave.plans.{name}")


def queries() -> dict[str, registry.Query]:
    _load()
    return {name: _in_utc(fn) for name, fn in registry.QUERIES.items()}


def _in_utc(fn: registry.Query) -> registry.Query:
    """Times without a zone are read as UTC."""
    def run(spark, folder):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, folder)
    return run


def oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
