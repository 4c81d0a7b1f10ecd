"""Modules that register queries; each has QUERIES and ORACLES."""

from __future__ import annotations

from types import ModuleType

from . import crawl_queries, parse_queries, part_queries, search_queries, skew_queries, stream_queries, table_queries, url_queries


def modules() -> list[ModuleType]:
    return [skew_queries, url_queries, search_queries, table_queries, crawl_queries, parse_queries, stream_queries, part_queries]


def flagship(spark, root):
    return search_queries.ft7_bm25(spark, root)
