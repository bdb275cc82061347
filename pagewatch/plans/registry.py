"""Every query of the library by name, and the SQL that says the same."""

from __future__ import annotations

from pagewatch.plans import changes, links, people, quotes, stats, stories, tables, text

MODULES = (text, tables, changes, quotes, links, people, stats, stories)
QUERIES: dict = {}
SQL: dict[str, str] = {}
for m in MODULES:
    if both := QUERIES.keys() & m.QUERIES.keys():
        raise ValueError(f"registered twice: {sorted(both)}")
    QUERIES |= m.QUERIES
    SQL |= m.SQL
