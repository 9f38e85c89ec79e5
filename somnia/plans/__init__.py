"""Registered queries over the given tables."""

from importlib import import_module

MODULES = ["project", "joins", "aggregates", "windows", "latent", "ordering", "scalars", "signals", "sampling", "models", "sources"]


def load() -> dict:
    """All queries by name."""
    for name in MODULES:
        import_module(f"somnia.plans.{name}")
    from .registry import REGISTRY
    return REGISTRY
