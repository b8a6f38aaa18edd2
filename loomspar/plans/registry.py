"""All queries of the core with their SQL."""

from __future__ import annotations

from loomspar.plans import eval_queries, graph_queries, normal_queries, pipeline_queries, record_queries, report_queries, text_queries, vector_queries

MODULES = (text_queries, graph_queries, record_queries, eval_queries, vector_queries, pipeline_queries, report_queries, normal_queries)
FLAGSHIP = "f01_chunks"
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
