"""All queries of the core and the SQL that gives the same rows."""

from __future__ import annotations

from lodestone.plans import answer_queries, benchmark_queries, evidence_queries, metric_queries, packed, retrieval_queries, system_queries, text_queries

_MODULES = (packed, text_queries, retrieval_queries, evidence_queries, metric_queries, benchmark_queries, answer_queries, system_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
FLAGSHIP = "hybrid_search"
