"""All queries of the library and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import package_queries, page_queries, resource_queries, scan_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in (text_queries, page_queries, package_queries, resource_queries, scan_queries):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
