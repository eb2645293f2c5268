"""Imports every binding module so that the registry is complete."""

from __future__ import annotations

import importlib
import pkgutil

import vacantic.bindings as package
from vacantic.bindings.registry import QUERIES, SQL, Query


def _load() -> None:
    for m in sorted(x.name for x in pkgutil.iter_modules(package.__path__)):
        if m.endswith("_queries"):
            importlib.import_module(f"vacantic.bindings.{m}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
