"""All registered queries of the engine's own operators."""

from __future__ import annotations

from veinlode.plans import coverage_queries, document_queries, history_queries, knowledge_queries, more_queries, source_queries  # noqa: F401  (register their queries)
from veinlode.plans.queries import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
