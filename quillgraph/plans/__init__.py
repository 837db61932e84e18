"""Registered queries: operators applied to the supplied tables, each with its SQL."""

import importlib

# Modules that register queries, in the order they are listed.
MODULES = ["text", "profiles", "indexes", "searches", "graphs", "clusters", "rounds", "classes"]


def load():
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
