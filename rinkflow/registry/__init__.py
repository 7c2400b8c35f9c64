"""All queries by name."""

from __future__ import annotations

import importlib

_MODULES = ("ingest", "features", "quality", "scoring", "metrics", "aging", "serving", "models", "streams")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")


def queries():
    from rinkflow.registry.core import QUERIES

    _load()
    return dict(QUERIES)


def oracles():
    from rinkflow.registry.core import ORACLES

    _load()
    return dict(ORACLES)


def flagship(spark, path):
    from rinkflow.registry.serving import flagship_board

    return flagship_board(spark, path)
