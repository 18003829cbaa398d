"""All queries of the core, with their SQL."""

from granthika.plans import analytics_queries, corpus_queries, problem_queries, retrieval_queries

_MODULES = (corpus_queries, retrieval_queries, analytics_queries, problem_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
