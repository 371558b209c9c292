"""All registered queries with their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil

from . import plans
from .plans import registry


def _load() -> None:
    for m in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"{plans.__name__}.{m.name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLE)
