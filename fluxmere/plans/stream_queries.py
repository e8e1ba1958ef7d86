"""Queries that read a table as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import documents


def newest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, as the newest version of a document."""
    changes = documents.arriving(spark, f"{sf_dir}/events.parquet")
    return documents.drained(documents.newest(changes, ["user_id"], "event_id", ["event_type", "value"]), "newest")


def arrivals_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = documents.arriving(spark, f"{sf_dir}/events.parquet")
    found = documents.drained(documents.counts(changes, "ts", "1 day", "2 days", "event_type"), "arrivals")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (newest_documents, arrivals_by_day)}

ORACLE = {
    "newest_documents": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "arrivals_by_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
