"""Shard placement by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table and shards take
turns in claiming the next free slot of theirs. A key's shard is the table's entry at the
hash of the key: one lookup in a table of fixed size, nearly equal shares, and few moves
when a shard comes or goes. The table has ``slots`` rows whatever the data's size, so it is
broadcast; rows are placed without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import unused

SLOTS = 65_537
MOST_SLOTS = 4_000_000


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard. ``slots`` is a prime greater than the number of shards."""
    if not shards or len(set(shards)) != len(shards) or not len(shards) < slots <= MOST_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("one or more distinct shards and a larger prime number of slots are needed")
    at = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def lookup(spark: SparkSession, table: list[int]) -> DataFrame:
    """(slot, shard) rows from one literal; the literal's size is that of the table."""
    entries = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1).select(F.posexplode(entries).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    """Of the text of a key; a null key goes where the empty text goes."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long") % slots).cast("int")


def assign(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (index into shards) of each row.

    Equal keys share a shard; a null key is placed as the empty text; repeated rows are kept;
    an empty table stays empty. Columns of df named slot or shard are replaced.
    """
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    at, to = unused("placed_slot", df), unused("placed_shard", df)
    table = lookup(df.sparkSession, fill(shards, slots)).toDF(at, to)
    placed = df.withColumn(at, slot_of(df[key], slots)).select(*kept, at)
    return placed.join(F.broadcast(table), at).select(*kept, F.col(at).alias("slot"), F.col(to).alias("shard"))
