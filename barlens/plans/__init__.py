"""Registered queries and the SQL they are checked against."""

from importlib import import_module

MODULES = (
    "clean_queries", "identity_queries", "history_queries", "universe_queries", "forecast_queries", "execution_queries", "dataset_queries",
    "evaluation_queries", "latent_queries", "source_queries",
)


def load():
    """Import every query module and return the filled registry."""
    for name in MODULES:
        import_module(f"barlens.plans.{name}")
    return import_module("barlens.plans.registry")
