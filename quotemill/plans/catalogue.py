"""All registered market queries and the SQL that states the same result."""

from __future__ import annotations

from quotemill.plans import bi, market, reports, stored, streams, technical

_MODULES = (bi, market, technical, reports, streams, stored)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: sql for m in _MODULES for k, sql in m.ORACLE_SQL.items()}
