"""The query catalogue: one entry per operator, over the given tables, with its SQL check."""

import importlib

MODULES = ("synthesis", "joins", "sources", "predicates", "scalars", "transforms", "structure", "splits", "quality", "metrics", "graph", "corpus")


def load():
    """(queries, oracle SQL) of every catalogue module."""
    from relweave.catalog import base

    for name in MODULES:
        importlib.import_module(f"relweave.catalog.{name}")
    return base.QUERIES, base.ORACLE
