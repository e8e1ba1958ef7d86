"""Registered queries over the reference tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_queries, code_queries, disk_queries, graph_queries, row_queries, stream_queries

_MODULES = (byte_queries, row_queries, graph_queries, disk_queries, code_queries, stream_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_queries.block_digests(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _MODULES for k, sql in m.ORACLE.items()}
