"""DuckDB SQL equivalents of the registered queries, for comparison only."""

from __future__ import annotations


def statements() -> dict[str, str]:
    from oracle import browsing, ingesting, scalars, search, statistics, threading, upkeep, vectors

    found: dict[str, str] = {}
    for module in (statistics, threading, browsing, scalars, upkeep, ingesting, search, vectors):
        found.update(module.SQL)
    return found
