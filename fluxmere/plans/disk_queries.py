"""Queries over disk images: every customer's orders are a file, and 50 customers share a floppy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import disks
from .tables import table

PER_DISK = 50


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, name, segment, data): a line for each order of the customer, by key."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    lines = F.array_join(F.transform("keys", lambda k: F.concat(F.lit("ORDER "), k.cast("string"), F.lit("\r"))), "")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.floor(F.col("c_custkey") / PER_DISK).cast("long").alias("image_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("name"),
        F.substring(F.col("c_mktsegment"), 1, 4).alias("segment"), F.encode(F.coalesce(lines, F.lit("")), "US-ASCII").alias("data"),
    )


def _dos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disks.dos_images(_files(spark, sf_dir).select("image_id", F.col("name").alias("path"), "data"))


def _prodos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disks.prodos_images(_files(spark, sf_dir).select("image_id", F.concat_ws("/", "segment", "name").alias("path"), "data"))


def dos_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic catalog rows of the track-linked images."""
    row = F.format_string("%-4s %5d  %s", "kind", "size", "path")
    return disks.files(_dos(spark, sf_dir)).select("image_id", row.alias("row"))


def dos_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file, read through the block order and a header."""
    images = disks.wrapped(disks.reordered(_dos(spark, sf_dir), True), True)
    return disks.files(images).select("image_id", "path", "eof", F.md5("data").alias("digest"))


def prodos_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of the block images with its depth, and the files that a directory holds."""
    found = disks.files(_prodos(spark, sf_dir)).select("image_id", "path", "kind", "size")
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    held = found.groupBy("image_id", parent.alias("path")).agg(F.count("*").alias("children"))
    depth = (F.size(F.split("path", "/")) - 2).cast("long")
    return found.join(held, ["image_id", "path"], "left").select("image_id", "path", "kind", depth.alias("depth"), "size", F.coalesce("children", F.lit(0)).alias("children"))


def prodos_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's end and content, read through logical sectors."""
    images = disks.reordered(_prodos(spark, sf_dir), False)
    return disks.files(images).where("kind <> 'DIR'").select("image_id", "path", "eof", F.md5("data").alias("digest"))


def disk_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container, file system and free space of images in six shapes, by image_id."""
    shape = F.pmod("image_id", F.lit(6))
    dos, blocks = _dos(spark, sf_dir), _prodos(spark, sf_dir)
    shapes = [dos.where(shape == 0), disks.reordered(dos.where(shape == 1), True), disks.wrapped(dos.where(shape == 2), False), blocks.where(shape == 3), disks.reordered(blocks.where(shape == 4), False), disks.wrapped(blocks.where(shape == 5), True)]
    found = shapes[0]
    for df in shapes[1:]:
        found = found.unionByName(df)
    return disks.identified(found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (dos_catalog, dos_files, prodos_tree, prodos_files, disk_identify)}

_FILES = f"""
WITH o AS (SELECT o_custkey, string_agg(concat('ORDER ', o_orderkey, chr(13)), '' ORDER BY o_orderkey) AS t FROM orders GROUP BY o_custkey),
f AS (SELECT c_custkey // {PER_DISK} AS image_id, concat('C', c_custkey) AS name, substr(c_mktsegment, 1, 4) AS segment, coalesce(t, '') AS t, CAST(length(coalesce(t, '')) AS BIGINT) AS n FROM customer LEFT JOIN o ON c_custkey = o_custkey),
s AS (SELECT *, CAST(ceil(n / 256.0) AS BIGINT) + greatest(1, CAST(ceil(n / 256.0 / 122) AS BIGINT)) AS sectors, CASE WHEN n <= 512 THEN 1 ELSE CAST(ceil(n / 512.0) AS BIGINT) + 1 END AS blocks FROM f),
d AS (SELECT image_id, segment, count(*) AS children, greatest(1, CAST(ceil((count(*) + 1) / 13.0) AS BIGINT)) AS size FROM s GROUP BY image_id, segment)"""

ORACLE = {
    "dos_catalog": _FILES + " SELECT image_id, printf('%-4s %5d  %s', 'T', sectors, name) AS row FROM s",
    "dos_files": _FILES + " SELECT image_id, name AS path, n AS eof, md5(t) AS digest FROM s",
    "prodos_tree": _FILES
    + """ SELECT image_id, concat('/D', image_id, '/', segment, '/', name) AS path, 'TXT' AS kind, CAST(2 AS BIGINT) AS depth, blocks AS size, CAST(0 AS BIGINT) AS children FROM s
UNION ALL SELECT image_id, concat('/D', image_id, '/', segment), 'DIR', 1, size, children FROM d""",
    "prodos_files": _FILES + " SELECT image_id, concat('/D', image_id, '/', segment, '/', name) AS path, n AS eof, md5(t) AS digest FROM s",
    "disk_identify": _FILES
    + """, k AS (SELECT image_id, image_id % 6 AS shape, 496 - sum(sectors) AS dos_free, 280 - 7 - sum(blocks) AS free FROM s GROUP BY image_id), u AS (SELECT image_id, sum(size) AS dirs FROM d GROUP BY image_id)
SELECT image_id, ['do', 'po', '2mg', 'po', 'do', '2mg'][shape + 1] AS container, CASE WHEN shape < 3 THEN 'dos' ELSE 'prodos' END AS system, CAST(CASE WHEN shape < 3 THEN dos_free ELSE free - dirs END AS BIGINT) AS free FROM k JOIN u USING (image_id)""",
}
