"""All registered queries outside the optional subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("repair", "mining", "relational", "analytics", "ingest", "streams", "ranking")
FLAGSHIP = "p1_report"


def all_queries() -> dict:
    """name -> (callable of session and folder, SQL or None)."""
    found: dict = {}
    for m in MODULES:
        own = import_module(f"{__package__}.{m}").QUERIES
        assert not found.keys() & own.keys(), found.keys() & own.keys()
        found |= own
    return found
