"""All queries over the synthetic tables and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from . import audits, content, evidence, library, permissions, readings, search, suite

_PARTS = (search, permissions, content, audits, suite, library, readings, evidence)
QUERIES: dict[str, Callable] = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
