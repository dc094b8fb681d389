"""Queries over the given tables, with equivalent SQL where SQL can say it."""

from importlib import import_module

MODULES = ("listings", "histories", "texts", "matching", "quality", "reevaluation", "fieldcases")


def load_all() -> None:
    """Import every catalog module so that its queries are registered."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
