"""Operators bound to the test tables, each with the SQL that says the same."""

from talkweave.plans import analytics_queries, catalog_queries, ops_queries, search_queries, text_queries

CORE_QUERIES = {}
CORE_SQL = {}
for _module in (search_queries, text_queries, analytics_queries, ops_queries, catalog_queries):
    CORE_QUERIES.update(_module.R.queries)
    CORE_SQL.update(_module.R.sql)
