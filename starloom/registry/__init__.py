"""Queries over the supplied tables, one per operator."""

from importlib import import_module

MODULES = (
    "scans", "filters", "joins", "aggregates", "windows", "sets", "scalars", "modelling",
    "quality", "semantic", "reconcile", "inventory", "lineage", "privacy", "streams",
)


def load_all():
    """Import every query module; return (queries, sql)."""
    from starloom.registry.base import QUERIES, SQL

    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, SQL
