"""Disk images as rows: building, identifying, listing and reading them.

An image is a binary column of at most 32 MB and is handled whole in one call; rows are
mapped, nothing is shuffled. Building groups files by image, and a group is bounded by what
an image holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..sources import disks
from ..storage import ship

FILE = "path string, kind string, size long, eof long, aux long, locked boolean, data binary"


def dos_images(files: DataFrame) -> DataFrame:
    """(image_id, image) from ``files(image_id, path, data)``: text files of a logical-sector floppy, in the order of path."""
    ship(files.sparkSession)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image = disks.linked_format()
        for path, data in sorted(zip(rows["path"], rows["data"], strict=True)):
            image = disks.linked_put(image, path, "T", bytes(data or b""))
        return pd.DataFrame({"image_id": [key[0]], "image": [image]})

    return files.groupBy("image_id").applyInPandas(build, "image_id long, image binary")


def prodos_images(files: DataFrame, blocks: int = 280) -> DataFrame:
    """(image_id, image) from ``files(image_id, path, data)``: a volume of blocks with its directories, in the order of path."""
    ship(files.sparkSession)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = [(path, "TXT", 0, bytes(data or b"")) for path, data in sorted(zip(rows["path"], rows["data"], strict=True))]
        return pd.DataFrame({"image_id": [key[0]], "image": [disks.blocked_put(disks.blocked_format(f"D{key[0]}", blocks), found)]})

    return files.groupBy("image_id").applyInPandas(build, "image_id long, image binary")


def identified(images: DataFrame) -> DataFrame:
    """(image_id, container, system, free); nulls where nothing fits."""
    ship(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [disks.identify(bytes(x)) if x is not None else None for x in batch["image"]]
            rows = [(k, v.container, v.system, v.free) if v else (k, None, None, None) for k, v in zip(batch["image_id"], found, strict=True)]
            yield pd.DataFrame(rows, columns=["image_id", "container", "system", "free"])

    return images.select("image_id", "image").mapInPandas(run, "image_id long, container string, system string, free long")


def files(images: DataFrame) -> DataFrame:
    """(image_id, path, kind, size, eof, aux, locked, data) of every file and directory; none for what isn't known."""
    ship(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["image_id", *(c.split()[0] for c in FILE.split(", "))]
        for batch in batches:
            for key, image in zip(batch["image_id"], batch["image"], strict=True):
                volume = disks.identify(bytes(image)) if image is not None else None
                rows = [(key, f.path, f.kind, f.size, len(f.data), f.aux, f.locked, f.data) for f in disks.files(volume)] if volume else []
                yield pd.DataFrame(rows, columns=names)

    return images.select("image_id", "image").mapInPandas(run, f"image_id long, {FILE}")


def reordered(images: DataFrame, to_blocks: bool) -> DataFrame:
    """Logical-sector images in block order, or back; other lengths than a floppy's stay."""
    ship(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(image=[disks.reordered(bytes(x), to_blocks) if x is not None and len(x) == disks.FLOPPY else x for x in batch["image"]])

    return images.select("image_id", "image").mapInPandas(run, "image_id long, image binary")


def wrapped(images: DataFrame, blocks: bool) -> DataFrame:
    """Images behind a 64-byte header."""
    ship(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(image=[disks.wrap(bytes(x), blocks) if x is not None else None for x in batch["image"]])

    return images.select("image_id", "image").mapInPandas(run, "image_id long, image binary")
