"""All registered queries of the relative-location engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.plans import clean_queries, export_queries, graph_queries, io_queries, relation_queries, salience_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (relation_queries, clean_queries, salience_queries, text_queries, graph_queries, export_queries, io_queries)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
