"""All registered queries over the given tables, and the SQL that expresses them."""

from __future__ import annotations

from . import corpus_queries, evaluation_queries, graph_queries, search_queries, source_queries, text_queries

FLAGSHIP = "npmi_graph"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (corpus_queries, graph_queries, search_queries, evaluation_queries, source_queries, text_queries):
    QUERIES.update(module.QUERIES)
    ORACLE_SQL.update(module.ORACLE_SQL)
