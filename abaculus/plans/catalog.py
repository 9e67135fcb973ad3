"""All queries of the library apart from the optional subpackage, and their SQL."""

from __future__ import annotations

from abaculus.plans import ledger_queries, source_queries  # noqa: F401  (the second registers with the first)

QUERIES = dict(ledger_queries.QUERIES)
SQL = dict(ledger_queries.SQL)
