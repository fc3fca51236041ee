"""All registered queries of the core, with the SQL that they are compared with."""

from __future__ import annotations

from corpusloom.plans import answer_queries, graph_queries, orphan_queries, profile_queries, retrieval_queries, source_queries

_MODULES = (source_queries, profile_queries, retrieval_queries, graph_queries, answer_queries, orphan_queries)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}
