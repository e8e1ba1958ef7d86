"""Sparse files as rows of chunks, and records over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binary

#: Fixed: version of the file image format.
FIMG_VERSION = "2.1.0"


def desequence(files: DataFrame, key: str, data: Column, size: int) -> DataFrame:
    """key, chunk_no, data, eof: fixed-width chunks; an empty file has none."""
    return files.select(key, data.alias("_data")).select(key, F.octet_length("_data").cast("long").alias("eof"), F.explode(binary.chunks(F.col("_data"), size)).alias("c")).select(key, "c.chunk_no", "c.data", "eof")


def sequence(chunks: DataFrame, key: str) -> DataFrame:
    """key, data, n_chunks, sparse: chunks joined by number; holes are skipped and mark the file as sparse."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "data"))).alias("all")
    found = chunks.groupBy(key).agg(ordered, F.count("*").alias("n_chunks"), F.max("chunk_no").alias("last"))
    return found.select(key, F.unhex(F.array_join(F.transform("all", lambda c: F.hex(c["data"])), "")).alias("data"), "n_chunks", (F.col("n_chunks") != F.col("last") + 1).alias("sparse"))


def records(chunks: DataFrame, key: str, length: int, size: int) -> DataFrame:
    """key, rec_no, text: fixed-length records of which all chunks are there, up to the first NUL; empty ones are left out.

    A record that ends where a chunk ends asks for the next chunk too. One shuffle: of the pieces of records.
    """
    first = F.greatest(F.ceil(F.col("chunk_no") * size / length).cast("long") - 1, F.lit(0).cast("long"))
    last = F.ceil((F.col("chunk_no") + 1) * size / length).cast("long") - 1
    met = chunks.select(key, "chunk_no", "data", F.explode(F.sequence(first, last)).alias("rec_no"))
    begin, end = F.floor(F.col("rec_no") * length / size).cast("long"), F.floor((F.col("rec_no") + 1) * length / size).cast("long")
    # a chunk gives each of its records the bytes that lie in it, and its number even where there are none
    at = F.col("rec_no") * length - F.col("chunk_no") * size
    piece = F.substring("data", F.greatest(at, F.lit(0)).cast("int") + 1, (length + F.least(at, F.lit(0))).cast("int"))
    parts = met.select(key, "rec_no", F.struct("chunk_no", piece.alias("data")).alias("part"))
    whole = parts.groupBy(key, "rec_no").agg(F.array_sort(F.collect_list("part")).alias("all")).where(F.col("all.chunk_no") == F.sequence(begin, end))
    joined = F.decode(F.unhex(F.array_join(F.transform("all", lambda c: F.hex(c["data"])), "")), "ISO-8859-1")
    text = F.substring_index(joined, "\x00", 1)
    return whole.select(key, "rec_no", text.alias("text")).where("text <> ''")


def is_sparse(chunk_no: str) -> Column:
    """Aggregate: whether the chunk numbers of a group aren't 0, 1, 2, ..."""
    return (F.min(chunk_no) != 0) | (F.max(chunk_no) + 1 != F.countDistinct(chunk_no))


#: Fixed: metadata of a file image, in order, in hexadecimal digits, least byte first.
_META = ("fs_type", "aux", "access", "accessed", "created", "modified", "version", "min_version")
_IMAGE = "struct<fimg_version: string, file_system: string, chunk_len: int, eof: string, " + ", ".join(f"{m}: string" for m in _META) + ", full_path: string, chunks: map<string, string>>"


def image_json(chunks: DataFrame, key: str, file_system: str, size: int, path: Column, version: str = FIMG_VERSION) -> DataFrame:
    """key, json: a file image for each file of ``chunks(key, chunk_no, data, eof)``; its chunks in the order of their numbers, metadata empty."""
    entry = F.struct("chunk_no", F.hex("data").alias("hex"))
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("all"), F.max("eof").alias("eof"))
    numbered = F.map_from_entries(F.transform("all", lambda c: F.struct(c["chunk_no"].cast("string"), c["hex"])))
    fields = [F.lit(version).alias("fimg_version"), F.lit(file_system).alias("file_system"), F.lit(size).alias("chunk_len"), F.hex(binary.le_bytes(F.col("eof"), 4)).alias("eof")]
    fields += [*(F.lit("").alias(m) for m in _META), path.alias("full_path"), numbered.alias("chunks")]
    return rows.select(key, F.to_json(F.struct(*fields)).alias("json"))


def image_chunks(images: DataFrame, key: str, json: Column) -> DataFrame:
    """key, chunk_no, data, eof of file images in JSON; none for what is no such image, or has digits that are no bytes."""
    parsed = images.select(key, F.from_json(json, _IMAGE).alias("f")).where("f.fimg_version is not null and f.file_system is not null and f.chunks is not null")
    each = parsed.select(key, F.explode(F.map_entries("f.chunks")).alias("c"), binary.le_int(F.unhex("f.eof")).alias("eof"))
    rows = each.select(key, F.col("c.key").try_cast("long").alias("chunk_no"), F.try_to_binary("c.value", F.lit("hex")).alias("data"), "eof")
    return rows.where("chunk_no is not null and data is not null")


def repaired(primary: Column, backup: Column, end: int) -> Column:
    """An allocation entry: that of the backup only where it alone points to a data cluster."""
    good = lambda v: (v >= 2) & (v < end)
    return F.when(~good(primary) & good(backup), backup).otherwise(primary)


def leaf_rows(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, path (array of names), leaf (text) of every leaf of a JSON object; objects are descended, arrays and scalars are leaves.

    A level at a time, until no object is left; empty objects have no leaves. What is no
    JSON, or no object, has none either.
    """
    spark = df.sparkSession
    level = df.select(*keys, F.array().cast("array<string>").alias("path"), F.try_parse_json(value.cast("string")).alias("v")).where(_is_object("v"))
    leaves = None
    while True:
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(*keys, F.concat("path", F.array("key")).alias("path"), F.col("value").alias("v"))
        found = inner.where(~_is_object("v")).select(*keys, "path", F.variant_get("v", "$", "string").alias("leaf"))
        leaves = found if leaves is None else leaves.unionByName(found)
        level = inner.where(_is_object("v"))
        if level.isEmpty():
            return leaves


def _is_object(name: str) -> Column:
    return F.coalesce(F.schema_of_variant(name).startswith("OBJECT"), F.lit(False))


def json_leaves(value: Column) -> Column:
    """array<struct<path, leaf>> of a JSON object's members; arrays and scalars are leaves, nested objects come as text."""
    members = F.from_json(value, "map<string,string>")
    return F.transform(F.map_entries(members), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("leaf")))
