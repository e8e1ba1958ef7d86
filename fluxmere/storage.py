"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids and numbers that may be sent to every task: some tens of MB.
SENT_ROWS = 200_000
#: Bytes of rows that go to a Python worker at once; bounds the buffers on both sides.
BATCH_BYTES = "2m"


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    ``spark.checkpoint.dir`` is used as it is. Where it is unset, a local session gets a
    folder of its own; a cluster session is refused, since no machine-local folder would do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if path:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(path)
        return path
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fluxmere-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: ends the lineage, and a lost executor re-reads instead of recomputing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder, which goes when the application ends.

    Like ``cut`` for what is wide or long: columns are compressed, and readers take only those they use.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """The folder goes when the application ends."""
    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def sent_if_small(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """A checkpointed table of narrow rows, marked for broadcast if a count shows it small; joined by shuffle beyond that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def gathered(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """A table of so many narrow rows in no more partitions than they fill, without a shuffle."""
    return df.coalesce(max(1, -(-rows // each)))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, which their Python workers import, once an application; and bound the Arrow batches of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="fluxmere-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(path := f"{folder}/{root.name}.zip", "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"{root.name}/{file.relative_to(root)}")
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
