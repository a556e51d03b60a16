"""Every reference-side query by name, with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


from almanack.plans import derive, feed, harvest, ingest, matching, organisers, people, reports, runs, text  # noqa: E402, F401
