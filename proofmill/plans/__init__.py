"""Bindings of operators to concrete tables, and the query registry."""

import importlib

MODULES = ("measurements", "aggregates", "evaluation", "relations", "quality", "modelling", "storage", "splitting", "panels", "regimes")


def load():
    from proofmill.plans import registry

    for m in MODULES:
        importlib.import_module(f"proofmill.plans.{m}")
    return registry
