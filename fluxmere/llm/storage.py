"""Shared-folder tables, and this package's code for the executors' Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..storage import SENT_ROWS, cut, fresh_path, gathered, remove_at_end, sent_if_small, shared_dir, ship, table

__all__ = ["SENT_ROWS", "cut", "fresh_path", "gathered", "remove_at_end", "sent_if_small", "settled", "shared_dir", "ship", "table"]


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint of narrow rows, read in no more partitions than they fill: later stages over few rows then have few tasks."""
    df = cut(df)
    return gathered(df, df.count())
