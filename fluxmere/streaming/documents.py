"""The newest state of documents whose versions arrive as a stream, and counts of what arrives by time.

State is kept by built-in aggregates in the state store, a row a document or a window and
kind; a version older than the one that is known changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, remove_at_end


def newest(changes: DataFrame, key: list[str], version: str, columns: list[str]) -> DataFrame:
    """key, version and columns of the greatest version of each key; of equal versions the greatest row. Null versions are ignored."""
    row = F.struct(version, *columns)
    return changes.where(F.col(version).isNotNull()).groupBy(*key).agg(F.max(row).alias("row")).select(*key, "row.*")


def counts(changes: DataFrame, time: str, every: str, late: str, kind: str) -> DataFrame:
    """start, kind, n for windows of ``every``; state of a window is let go once ``late`` has passed after its end."""
    windows = changes.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, every).alias("w"), kind).agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").alias("start"), kind, "n")


def arriving(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of the rows of Parquet files as they come into a folder, or of one file."""
    whole = path.rstrip("/")
    pattern = f"{whole[:-1]}[{whole[-1]}]"  # a pattern for just this path: the stream takes a plain one for a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(pattern)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a complete-mode stream comes to when all that is there now has been read; each batch writes a table of its own in the shared folder."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    remove_at_end(spark, path)
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last.append(number)

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[-1]}") if last else spark.createDataFrame([], stream.schema)
