"""Queries over the driver tables."""


def load_all():
    """Import every query module; gives the registry."""
    import importlib

    from . import catalog

    for name in ("parsing_queries", "statistics_queries", "session_queries", "rule_queries", "stream_queries"):
        importlib.import_module(f"{__name__}.{name}")
    return catalog
