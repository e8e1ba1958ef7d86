"""Runs, neighbours and running values over ordered rows: windows partitioned by a key.

Every function keeps the other columns of its input. A window holds the rows of one key (one
disk, one program, one document), so keys spread over the cluster; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: list[str], order: list[str], flag: Column) -> DataFrame:
    """Rows where ``flag`` holds, with ``position`` (from 0 within the key) and ``island``, the same in a run of them."""
    over = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("position", F.row_number().over(over) - 1).where(F.coalesce(flag, F.lit(False)))
    return rows.withColumn("island", F.col("position") - F.row_number().over(over))


def free_runs(df: DataFrame, key: list[str], order: list[str], free: Column) -> DataFrame:
    """key, free (rows that are), largest (the longest run of them); keys with none have zeros."""
    runs = islands(df, key, order, free).groupBy(*key, "island").agg(F.count("*").alias("n"))
    found = runs.groupBy(*key).agg(F.sum("n").alias("free"), F.max("n").alias("largest"))
    zero = F.lit(0).cast("long")
    return df.select(*key).distinct().join(found, key, "left").select(*key, F.coalesce("free", zero).alias("free"), F.coalesce("largest", zero).alias("largest"))


def first_fit(df: DataFrame, key: list[str], order: list[str], free: Column, need: int) -> DataFrame:
    """key, start: position of the first run of at least ``need`` free rows; keys without one are left out."""
    runs = islands(df, key, order, free).groupBy(*key, "island").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    return runs.where(F.col("n") >= need).groupBy(*key).agg(F.min("first").cast("long").alias("start"))


def motor_stops(df: DataFrame, key: list[str], position: str, value: str) -> DataFrame:
    """key, stop: head positions worth visiting; of every four quarter tracks, those that hold data (non-null ``value``).

    Rows are quarter tracks with ``position`` from 0 without gaps. Where neither centre nor
    neighbour holds data the centre is visited.
    """
    over = Window.partitionBy(*key).orderBy(position)
    back = lambda k: F.lag(value, k).over(over)
    quads = df.select(*key, F.col(position).alias("m"), F.col(value).alias("h"), back(1).alias("qp"), back(2).alias("w"), back(3).alias("qm")).where("m % 4 = 2")
    has = lambda c: F.col(c).isNotNull()
    m = F.col("m").cast("long")
    both = F.when(F.col("w") == F.col("h"), F.array(m - 2)).otherwise(F.array(m - 2, m))
    alone = F.when(has("h"), F.array(m)).when(has("qp"), F.array(m - 1)).when(has("qm"), F.array(m - 3)).otherwise(F.array(m - 2))
    return quads.select(*key, F.explode(F.when(has("w") & has("h"), both).when(~has("w"), alone).otherwise(F.array(m - 2))).alias("stop"))


def renumber(df: DataFrame, key: list[str], order: list[str], number: str, pinned: Column, start: int, step: int) -> DataFrame:
    """Adds ``new_number``: start, start + step, ...; a pinned row keeps its number and the progression goes on from it.

    The first row of a key always gets ``start``.
    """
    over = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("_n", F.row_number().over(over)).withColumn("_p", F.coalesce(pinned, F.lit(False)) & (F.col("_n") > 1))
    rows = rows.withColumn("_segment", F.sum(F.col("_p").cast("long")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*key, "_segment").orderBy(*order)
    base = F.when(F.col("_segment") == 0, F.lit(start).cast("long")).otherwise(F.first(F.col(number).cast("long")).over(inside))
    return rows.withColumn("new_number", base + (F.row_number().over(inside) - 1) * step).drop("_n", "_p", "_segment")


def next_surviving(df: DataFrame, key: list[str], order: list[str], number: str, deleted: Column) -> DataFrame:
    """The deleted rows with ``target``: the number of the first surviving row after each; null at the end."""
    after = Window.partitionBy(*key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("_gone", deleted).withColumn("target", F.first(F.when(~F.col("_gone"), F.col(number)), True).over(after)).where("_gone").drop("_gone")


def deltas(df: DataFrame, key: list[str], line: str, column: str) -> DataFrame:
    """Adds delta_line and delta_column against the row before; on a new line the column counts from its start."""
    over = Window.partitionBy(*key).orderBy(line, column)
    zero = F.lit(0)
    moved = F.col(line) - F.coalesce(F.lag(line).over(over), zero)
    return df.withColumn("delta_line", moved.cast("long")).withColumn("delta_column", F.when(moved == 0, F.col(column) - F.coalesce(F.lag(column).over(over), zero)).otherwise(F.col(column)).cast("long"))


def running_sum(df: DataFrame, key: list[str], order: list[str], value: Column, start: int, name: str) -> DataFrame:
    """Adds ``name``: start plus the values up to and with this row, such as addresses of lines that follow each other."""
    over = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, (F.lit(start) + F.sum(value).over(over)).cast("long"))


def comment_blocks(df: DataFrame, key: list[str], order: list[str], comment: Column, text: str) -> DataFrame:
    """key, first, block: each run of comment rows as one text, lines joined by LF."""
    runs = islands(df, key, order, comment)
    lines = F.array_sort(F.collect_list(F.struct("position", text)))
    return runs.groupBy(*key, "island").agg(F.min("position").cast("long").alias("first"), lines.alias("lines")).select(*key, "first", F.array_join(F.transform("lines", lambda x: x[text]), "\n").alias("block"))


def percentile_bin(df: DataFrame, key: list[str], bin_: Column, percent: int) -> DataFrame:
    """key, bin: the least bin at which more than ``percent`` of the rows have been counted. Only the histogram is ordered."""
    counted = df.groupBy(*key, bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    shares = counted.select(*key, "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy(*key)).alias("total"))
    return shares.where(F.col("upto") * 100 > F.col("total") * percent).groupBy(*key).agg(F.min("bin").alias("bin"))
