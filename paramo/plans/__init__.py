"""Input bindings and the catalogue of registered queries with their oracle SQL."""

import importlib

PARTS = ["ingest", "clean", "reads", "dashboards", "features", "texts", "outliers", "forecasts", "learning", "live"]


def load_catalog():
    """Import every part of the catalogue and return it."""
    for part in PARTS:
        importlib.import_module(f"paramo.plans.{part}")
    return importlib.import_module("paramo.plans.catalog")
