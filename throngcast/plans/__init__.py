"""Views over the given tables and the registered queries."""

from importlib import import_module


def load_all():
    """All registered queries by name."""
    from . import catalog
    for part in ("risk", "zones", "routes", "presence", "video", "models", "streams", "files", "scans", "inference"):
        import_module(f"{__name__}.queries_{part}")
    return catalog.QUERIES
