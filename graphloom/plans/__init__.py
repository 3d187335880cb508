"""Queries by name, each a function of (spark, folder of tables), and the SQL that says the same."""

from graphloom.plans import data, etl_queries, format_queries, graph_queries, model_queries

MODULES = [data, graph_queries, etl_queries, model_queries, format_queries]
