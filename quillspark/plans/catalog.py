"""All registered queries with their DuckDB twins."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["text_queries", "corpus_queries", "model_queries", "event_queries",
            "stream_queries"]


def all_queries() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for name in _MODULES:
        part = import_module(f"{__package__}.{name}").QUERIES
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        found.update(part)
    return found
