"""One module per section; importing a module registers its queries."""

import importlib

MODULES = ("panel", "window_queries", "outcomes", "source_queries", "ledger_queries",
           "inference_queries", "model_queries")


def _load():
    for name in MODULES:
        importlib.import_module(f"queries.{name}")
    from queries import base
    return base


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
