"""Name -> query and oracle SQL of every operator."""

from __future__ import annotations

from . import bibliography, catalog, documents, live, planning, records, relations, sources  # noqa: F401  (all add to the catalogue)


def queries():
    return {name: run for name, (run, _) in catalog.CATALOG.items()}


def oracles():
    return {name: sql for name, (_, sql) in catalog.CATALOG.items() if sql}
