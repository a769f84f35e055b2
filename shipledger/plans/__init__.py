"""The derived catalogue and the registered queries on it."""

from importlib import import_module

MODULES = ["comparison", "selection", "histories", "devices", "extraction", "documents", "indexes"]


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"shipledger.plans.{name}")
