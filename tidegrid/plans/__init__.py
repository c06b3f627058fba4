"""Registered queries and their SQL."""

from tidegrid.plans import greedy_queries, json_queries, model_queries, report_queries, sample_queries, semantic_queries, situation_queries, snapshot_queries, table_queries, timeline_queries

_ALL = (timeline_queries, table_queries, sample_queries, semantic_queries, model_queries, greedy_queries, json_queries, situation_queries, snapshot_queries, report_queries)
QUERIES = {name: f for module in _ALL for name, f in module.QUERIES.items()}
SQL = {name: sql for module in _ALL for name, sql in module.SQL.items()}
