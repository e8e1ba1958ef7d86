"""Addresses of blocks and sectors: fixed tables joined by broadcast, and arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sector orders and zones of disks.
DOS_SKEW = [0, 13, 11, 9, 7, 5, 3, 1, 14, 12, 10, 8, 6, 4, 2, 15]
FIRST_SECTORS = [0, 13, 11, 9, 7, 5, 3, 1]
SECOND_SECTORS = [14, 12, 10, 8, 6, 4, 2, 15]
ZONE_SECTORS = [12, 11, 10, 9, 8]
ZONE_TRACKS = 16


def zones(spark: SparkSession, sides: int = 1) -> DataFrame:
    """(zone, first, last, sectors, track): five zones of sixteen cylinders; blocks first to last."""
    rows, first = [], 0
    for k, n in enumerate(ZONE_SECTORS):
        size = ZONE_TRACKS * n * sides
        rows.append((k, first, first + size - 1, n, ZONE_TRACKS * sides * k))
        first += size
    return spark.createDataFrame(rows, "zone int, first long, last long, sectors long, track long")


def block_sectors_525(block: Column) -> Column:
    """array of (track, logical sector) for a 512-byte block of a 16-sector disk."""
    pick = lambda table: F.get(F.array(*(F.lit(x) for x in table)), (block % 8).cast("int")).cast("long")
    track = F.floor(block / 8).cast("long")
    return F.array(*(F.struct(track.alias("track"), pick(t).alias("sector")) for t in (FIRST_SECTORS, SECOND_SECTORS)))


def block_sector_35(blocks: DataFrame, block: str, sides: int = 1) -> DataFrame:
    """Adds zone, track and sector of a block on a disk with zones; blocks outside it are left out. Five rows are broadcast."""
    found = blocks.join(F.broadcast(zones(blocks.sparkSession, sides)), F.col(block).between(F.col("first"), F.col("last")))
    turn = F.col(block) - F.col("first")
    return found.withColumns({"track": (F.col("track") + F.floor(turn / F.col("sectors"))).cast("long"), "sector": (turn % F.col("sectors")).cast("long")}).drop("first", "last", "sectors")


def skewed(sector: Column, table: list[int] = DOS_SKEW) -> Column:
    return F.get(F.array(*(F.lit(x) for x in table)), sector.cast("int")).cast("long")


def logical_sectors(block: Column, shift: int, offset: int, per_track: int) -> Column:
    """array of (track, sector from 1) that make up a CP/M block of 2**shift records."""
    n = 1 << shift
    return F.transform(F.sequence(block * n, block * n + n - 1), lambda s: F.struct((F.floor(s / per_track) + offset).cast("long").alias("track"), (s % per_track + 1).cast("long").alias("sector")))


def ranges(request: Column) -> Column:
    """array<bigint> for a..b and n, regions joined by two commas; half-open, in order, repeats kept; null if it isn't a request."""
    part = lambda p: F.when(p.contains(".."), F.when(F.split(p, r"\.\.")[0].cast("long") < F.split(p, r"\.\.")[1].cast("long"), F.sequence(F.split(p, r"\.\.")[0].cast("long"), F.split(p, r"\.\.")[1].cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))).otherwise(F.array(p.cast("long")))
    return F.when(request.rlike(r"^\d+(\.\.\d+)?(,,\d+(\.\.\d+)?)*$"), F.flatten(F.transform(F.split(request, ",,"), part)))
