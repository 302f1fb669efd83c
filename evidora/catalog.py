"""All queries of the core library and their SQL."""

from __future__ import annotations

from evidora import queries_corpus, queries_events, queries_expansion, queries_more, queries_plans, queries_rows, queries_search, queries_selection

_MODULES = (queries_rows, queries_corpus, queries_search, queries_more, queries_expansion, queries_selection, queries_plans, queries_events)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.SQL.items()}
FLAGSHIP = "p5_found"
