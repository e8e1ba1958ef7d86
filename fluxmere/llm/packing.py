"""Sequence packing: shortest-pack-first over the length histogram.

Documents longer than a sequence give full pieces and a remainder. Only the histogram of
piece lengths (at most ``max_tokens`` rows) reaches the driver. There lengths are placed
longest first, each into the emptiest kind of pack that holds it, with counts instead of
single documents. The patterns then meet the pieces by the rank of a piece among those of
its length; ranks are taken within salted shares of a length, so a length that a third of
all documents has is ranked by many tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pretokens
from .storage import cut, ship

#: Pieces of a length that one task ranks.
SHARE = 1000
END = 1


def shortest_pack_first(histogram: dict[int, int], room: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of packs, [(length, how many of it), ...]) for each pattern; lengths from 1 to room."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            rest = max((r for r, packs in open_.items() if packs and r >= length), default=None)
            if rest is None:
                open_[room - length].append((left, [(length, 1)]))
                break
            count, items = open_[rest].pop()
            used = min(count, left)
            if used < count:
                open_[rest].append((count - used, items))
            grown = [*items[:-1], (length, items[-1][1] + 1)] if items[-1][0] == length else [*items, (length, 1)]
            open_[rest - length].append((used, grown))
            left -= used
    merged: Counter = Counter()
    for packs in open_.values():
        for count, items in packs:
            merged[tuple(items)] += count
    return [(count, list(items)) for items, count in sorted(merged.items(), reverse=True)]


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, packs, first sequence, offset), ordered: where the ranks of a length go."""
    taken: Counter = Counter()
    rows, base = [], 0
    for count, items in patterns:
        offset = 0
        for length, many in items:
            rows.append((length, taken[length], count, base, offset))
            taken[length] += count * many
            offset += length * many
        base += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(path: str, kinds: bytes, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pretokens.encoder(path, kinds)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            rows, at = [], []
            for i, ids in enumerate(encoder.encode(batch.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for start in range(0, len(ids), room):
                    part = ids[start : start + room]
                    at.append(i)
                    rows.append((start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            cols = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(cols[:, k]) for k in range(4))], names=names)

    return run


def _placed(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            turn = rank - row[:, 1]
            sequence, offset = row[:, 3] + turn % row[:, 2], row[:, 4] + turn // row[:, 2] * length
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 2048) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file with a byte-level pre-tokenizer, which
    executors have. A document is its ids, with the vocabulary's special strings read as their
    ids, and the id 1; a null or empty text is that id alone. A repeated row and rows with the
    same doc_id are packed as often as they come; a null doc_id stays null. Other columns are
    ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = docs.mapInArrow(_pieces(tokenizer, zlib.compress(pretokens.classes(tokenizer)), max_tokens), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = cut(pieces.withColumn("salt", F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(shortest_pack_first(histogram, max_tokens)))

    shares = {length: -(-n // SHARE) for length, n in histogram.items() if n > SHARE}
    many = F.lit(1)
    if shares:
        of = F.create_map(*(F.lit(x) for pair in sorted(shares.items()) for x in pair))
        many = F.coalesce(F.try_element_at(of, F.col("length").cast("int")), F.lit(1))
    dealt = pieces.withColumn("share", F.pmod("salt", many)).drop("salt")
    counts = cut(dealt.groupBy("length", "share").agg(F.count("*").alias("n")))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))).select("length", "share", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = dealt.withColumn("own", F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32")))
    ranked = ranked.join(before, ["length", "share"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked.select(*columns, "rank").mapInArrow(_placed(slots), ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"]))
