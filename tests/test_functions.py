import datetime as dt
import random
import zlib

from pyspark.sql import functions as F

import __spark_entry__ as entry
from fluxmere.functions import binary, text, times
from fluxmere.operators import files, geometry, graphs, runs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_checksums(spark):
    data = b"123456789"
    values = binary.byte_list(F.lit(bytearray(data)))
    assert one(spark, binary.crc16(values, 0x1021, 0xFFFF)) == 0x29B1
    crc = 0
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = ((crc << 1) ^ (0xA097 if crc & 0x8000 else 0)) & 0xFFFF
    assert one(spark, binary.crc16(values, 0xA097, 0)) == crc
    assert one(spark, F.crc32(F.lit(bytearray(data)))) == zlib.crc32(data)


def test_disk_bytes_round_trip(spark):
    values = list(range(256))
    col = F.array(*map(F.lit, values))
    assert one(spark, binary.decode_44(binary.encode_44(col))) == values
    assert one(spark, binary.decode_with(binary.encode_62(col), binary.NIBBLES_62)) == [v & 63 for v in values]
    assert one(spark, binary.decode_with(binary.encode_53(col), binary.NIBBLES_53)) == [v & 31 for v in values]
    assert one(spark, binary.decode_44(F.array(F.lit(0), F.lit(1)))) == [None]
    assert (len(binary.NIBBLES_62), binary.NIBBLES_62[0], binary.NIBBLES_62[-1]) == (64, 0x96, 0xFF)
    assert (len(binary.NIBBLES_53), binary.NIBBLES_53[0], binary.NIBBLES_53[-1]) == (32, 0xAB, 0xFF)


def test_bytes_and_fat12(spark):
    assert one(spark, binary.byte_list(F.lit(bytearray(range(256))))) == list(range(256))
    assert one(spark, binary.byte_list(F.lit(bytearray()))) == []
    assert one(spark, binary.le_int(F.lit(bytearray([1, 2, 3])))) == 0x030201
    assert bytes(one(spark, binary.le_bytes(F.lit(0x01020304), 3))) == b"\x04\x03\x02"
    assert one(spark, binary.fat12(binary.byte_list(F.lit(bytearray([0x12, 0x34, 0x56]))))) == [0x412, 0x563]


def test_sparse_files(spark):
    random.seed(3)
    data = [(k, bytearray(random.randbytes(k * 100))) for k in range(5)]
    df = spark.createDataFrame(data, "k long, b binary")
    parts = files.desequence(df, "k", F.col("b"), 64)
    assert {r["k"]: bytes(r["data"]) for r in files.sequence(parts, "k").collect()} == {k: bytes(b) for k, b in data if b}
    holed = parts.where("k = 4 and chunk_no <> 2")
    assert files.sequence(holed, "k").first()["sparse"]
    # the last record ends with the last chunk, so it asks for one more and is left out
    got = files.records(spark.createDataFrame([(1, 0, bytearray(b"ab\0cde")), (1, 1, bytearray(b"gh\0ijk"))], "k long, chunk_no long, data binary"), "k", 3, 6)
    assert rows(got) == [(1, 0, "ab"), (1, 1, "cde"), (1, 2, "gh")]


def test_texts(spark):
    coded = text.to_dos(F.lit("Ab\r\nc\n"))
    assert one(spark, coded) == [0xC1, 0xE2, 0x8D, 0xE3, 0x8D]
    assert one(spark, text.from_dos(coded)) == "Ab\nc\n"
    assert one(spark, text.to_dos(F.lit("é"))) is None
    assert one(spark, text.from_cpm(F.lit(bytearray(b"a\r\nb\xff\x1ac")))) == "a\nb\0"
    assert one(spark, text.unpack_kind(F.lit(bytearray(b"a\xff")))) == "binary"
    assert one(spark, text.escaped_ascii(F.lit(bytearray(b"A\n\xff")))) == "A\\x0A\\xFF"
    assert one(spark, text.catalog_row(F.lit("TXT"), F.lit(7), F.lit("X"))) == "TXT      7  X"
    assert one(spark, text.column_format(F.split(F.lit("LAB LDA #1 ;c"), " "))) == "LAB      LDA   #1         ;c"
    assert one(spark, text.column_format(F.split(F.lit(";c"), " "))) == " " * 26 + ";c"


def test_patterns(spark):
    match = lambda p, base, kind: one(spark, text.wildcard_match(F.lit(base), F.lit(kind), p))
    assert match("*.TXT", "read", "txt") and match("R?AD.*", "read", "me") and match("", "x", "y")
    assert not match("*", "read", "me") and not match("REA.*", "read", "me") and not match("*.*", "..", "")
    glob = lambda p, s: one(spark, text.glob(F.lit(s), p))
    assert glob("/v/*.txt", "/V/A.TXT") and glob("/v/**/a", "/v/x/y/a") and glob("/v/{a,b}", "/v/b")
    assert not glob("/v/*", "/v/x/y") and not glob("[!a]", "a")
    assert one(spark, text.name_valid(F.lit("readme.txt"), "fat")) and not one(spark, text.name_valid(F.lit("1abc"), "prodos"))


def test_times(spark):
    stamp = F.lit("2024-02-29 13:45:59").cast("timestamp_ntz")
    d, t = times.prodos_pack(stamp)
    assert one(spark, times.prodos_unpack(d, t)) == dt.datetime(2024, 2, 29, 13, 45)
    d, t, s = times.fat_pack(stamp)
    assert one(spark, times.fat_unpack(d, t, s)) == dt.datetime(2024, 2, 29, 13, 45, 59)
    n, h, m = times.cpm_pack(stamp)
    assert one(spark, times.cpm_unpack(n, h, m)) == dt.datetime(2024, 2, 29, 13, 45)
    assert one(spark, times.prodos_unpack(F.lit(0), F.lit(0))) is None
    assert one(spark, times.fat_unpack(F.lit(0), F.lit(0), F.lit(0))) is None
    assert one(spark, times.pascal_unpack(times.pascal_pack(F.lit("2000-02-29").cast("timestamp_ntz")))) is None


def test_runs(spark):
    df = spark.createDataFrame([(1, k, c) for k, c in enumerate("fuffuf")] + [(2, 0, "u")], "d int, n int, s string")
    assert rows(runs.free_runs(df, ["d"], ["n"], F.col("s") == "f")) == [(1, 4, 2), (2, 0, 0)]
    assert rows(runs.first_fit(df, ["d"], ["n"], F.col("s") == "f", 2)) == [(1, 2)]
    new = runs.renumber(df.where("d = 1"), ["d"], ["n"], "n", F.col("n") == 3, 100, 10)
    assert [r["new_number"] for r in new.orderBy("n").collect()] == [100, 110, 120, 3, 13, 23]
    assert rows(runs.next_surviving(df.where("d = 1"), ["d"], ["n"], "n", F.col("s") == "f").select("n", "target")) == [(0, 1), (2, 4), (3, 4), (5, None)]
    assert runs.free_runs(df.limit(0), ["d"], ["n"], F.col("s") == "f").count() == 0


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (None, 4)], "src int, dst int")
    assert rows(graphs.closure(edges, 8)) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    assert rows(graphs.closure(edges, 1)) == [(1, 3), (2, 1), (3, 2)]
    names = spark.createDataFrame([("alpha",), ("alps$",), ("album",), ("a",)], "w string")
    assert rows(graphs.collisions(names.withColumn("k", F.lit(1)), ["k"], F.col("w"))) == [(1, "al", ["album", "alpha"])]
    docs = spark.createDataFrame([("file:///x/a/p.bas",), ("file:///x/b/p.bas",), ("file:///q.bas",)], "uri string")
    paths = spark.createDataFrame([("B/P.BAS",), ("p.bas",), ("q.bas",)], "path string")
    assert rows(graphs.best_suffix(paths, docs)) == [("B/P.BAS", "file:///x/b/p.bas", 2), ("q.bas", "file:///q.bas", 1)]


def test_ranges(spark):
    assert one(spark, geometry.ranges(F.lit("1..4,,2,,5..5"))) == [1, 2, 3, 2]
    assert one(spark, geometry.ranges(F.lit("1,2"))) is None


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "n_bytes", "n_blocks", "n_uniform", "stored_bytes", "row"]
