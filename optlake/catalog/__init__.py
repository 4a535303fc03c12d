"""Registered queries over the given tables, each with the SQL that checks it."""

from importlib import import_module

from optlake.catalog.registry import ORACLES, QUERIES, with_views

MODULES = (
    "assignments",
    "guards",
    "scores",
    "rules",
    "texts",
    "fleet",
    "packages",
    "history",
    "graph",
    "streams",
)


def load() -> tuple[dict, dict]:
    for name in MODULES:
        import_module(f"optlake.catalog.{name}")
    return QUERIES, {name: with_views(sql, 1) for name, sql in ORACLES.items()}
