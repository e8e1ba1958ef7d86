"""Byte-level functions on BINARY columns, all of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# The 4-to-5 bit group code of G64 disks, by nibble value.
G64 = [0x0A, 0x0B, 0x12, 0x13, 0x0E, 0x0F, 0x16, 0x17, 0x09, 0x19, 0x1A, 0x1B, 0x0D, 0x1D, 0x1E, 0x15]


def _disk_bytes(pairs_of_zeros: int, adjacent_ones: bool) -> list[int]:
    """Bytes with the high bit set that a drive can read back, without the two that mark fields."""
    out = []
    for b in range(0x80, 0x100):
        bits = f"{b:08b}"
        zeros = sum(bits[k : k + 2] == "00" for k in range(7))
        if zeros <= pairs_of_zeros and (not adjacent_ones or "11" in bits[1:]) and b not in (0xAA, 0xD5):
            out.append(b)
    return out


NIBBLES_62 = _disk_bytes(1, True)
NIBBLES_53 = _disk_bytes(0, False)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once."""
    return F.transform(F.array(value), body)[0]


def utf8(text: Column) -> Column:
    return F.encode(text, "utf-8")


def byte_list(data: Column) -> Column:
    """Bytes as array<int>; empty for empty data."""
    latin = F.decode(data, "ISO-8859-1")
    return F.when(F.octet_length(data) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(latin, ""), lambda c: F.ascii(c)))


def latin(data: Column) -> Column:
    """A character for each byte; scans over it are native, where a lambda takes its bytes one by one."""
    return F.decode(data, "ISO-8859-1")


def mapped(data: Column, units: list[int], charset: str = "ISO-8859-1") -> Column:
    """Bytes with each replaced by the unit of the table, as ``charset`` writes it; no unit is 0 unless its byte is."""
    moved = [k for k in range(256) if units[k] != k]
    return F.encode(F.translate(latin(data), "".join(map(chr, moved)), "".join(chr(units[k]) for k in moved)), charset)


def hex_of(values: Column) -> Column:
    """Upper-case hex of an array<int> of bytes."""
    return F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")


def binary_of(values: Column) -> Column:
    return F.unhex(hex_of(values))


def chunk_count(data: Column, size: int) -> Column:
    return F.ceil(F.octet_length(data) / size).cast("long")


def chunks(data: Column, size: int) -> Column:
    """array<struct<chunk_no, data>> of fixed-width pieces; empty data has none."""
    piece = lambda k: F.struct(k.cast("long").alias("chunk_no"), F.substring(data, k * size + 1, F.lit(size)).alias("data"))
    return F.when(F.octet_length(data) == 0, F.lit(None)).otherwise(F.transform(F.sequence(F.lit(0), (F.ceil(F.octet_length(data) / size) - 1).cast("int")), piece))


def quantize(data: Column, size: int) -> Column:
    """Exactly ``size`` bytes: longer data is cut, shorter is padded with zeros."""
    return F.rpad(data, size, F.unhex(F.lit("00")))


def le_int(data: Column) -> Column:
    """Unsigned little-endian value of up to 7 bytes."""
    return F.conv(F.hex(F.unhex(F.array_join(F.reverse(F.transform(byte_list(data), lambda x: F.lpad(F.hex(x.cast("long")), 2, "0"))), ""))), 16, 10).cast("long")


def le_bytes(value: Column, size: int) -> Column:
    """The low ``size`` bytes of an integer, least first; higher ones are dropped."""
    each = F.array(*(F.shiftrightunsigned(value.cast("long"), 8 * k).bitwiseAND(F.lit(255).cast("long")) for k in range(size)))
    return binary_of(each)


def uniform(data: Column) -> Column:
    """Whether all bytes are equal; true for empty data."""
    return F.size(F.array_distinct(byte_list(data))) <= 1


def xor_checksum(data: Column) -> Column:
    return F.aggregate(byte_list(data), F.lit(0), lambda a, x: a.bitwiseXOR(x))


def crc16_table(polynomial: int) -> list[int]:
    out = []
    for high in range(256):
        crc = high << 8
        for _ in range(8):
            crc = (crc << 1) ^ polynomial if crc & 0x8000 else crc << 1
        out.append(crc & 0xFFFF)
    return out


def crc16(values: Column, polynomial: int, seed: int) -> Column:
    """Most significant bit first, of array<int>; one table look-up a byte."""
    table = F.array(*(F.lit(x) for x in crc16_table(polynomial)))
    step = lambda crc, b: F.shiftleft(crc.bitwiseAND(255), 8).bitwiseXOR(F.get(table, F.shiftright(crc, 8).bitwiseXOR(b)))
    return F.aggregate(values, F.lit(seed), step)


def encode_44(values: Column) -> Column:
    """Odd bits, then even bits, of each byte."""
    return F.flatten(F.transform(values, lambda x: F.array(F.shiftright(x, 1).bitwiseOR(0xAA), x.bitwiseOR(0xAA))))


def bytes_44(data: Column) -> Column:
    """``encode_44`` of binary data, in one scan."""
    return mapped(data, [(x >> 1 | 0xAA) << 8 | x | 0xAA for x in range(256)], "UTF-16BE")


def bytes_62(data: Column) -> Column:
    """``encode_62`` of binary data, in one scan."""
    return mapped(data, [NIBBLES_62[x & 63] for x in range(256)])


def bytes_53(data: Column) -> Column:
    """``encode_53`` of binary data, in one scan."""
    return mapped(data, [NIBBLES_53[x & 31] for x in range(256)])


def bytes_g64(data: Column) -> Column:
    """``encode_g64`` of binary data, in one scan; a unit with the second byte high is no surrogate."""
    return mapped(data, [(G64[x & 15] << 6 & 255) << 8 | G64[x >> 4] << 3 | G64[x & 15] >> 2 for x in range(256)], "UTF-16LE")


def decode_44(values: Column) -> Column:
    """Inverse of ``encode_44``; null for a pair that it can't have made."""
    valid = lambda x: x.bitwiseAND(0xAA) == 0xAA
    one = lambda a, b: F.when(valid(a) & valid(b), F.shiftleft(a, 1).bitwiseOR(1).bitwiseAND(b))
    side = lambda v, odd: F.filter(F.transform(v, lambda x, k: F.when(k % 2 == odd, x)), lambda x: x.isNotNull())
    return let(values, lambda v: F.zip_with(side(v, 0), side(v, 1), one))


def _looked_up(values: Column, table: list[int], mask: int) -> Column:
    entries = F.array(*(F.lit(x) for x in table))
    return F.transform(values, lambda x: F.get(entries, x.bitwiseAND(mask)))


def encode_62(values: Column) -> Column:
    """Low six bits of each value as a disk byte."""
    return _looked_up(values, NIBBLES_62, 63)


def encode_53(values: Column) -> Column:
    """Low five bits of each value as a disk byte."""
    return _looked_up(values, NIBBLES_53, 31)


def decode_with(values: Column, table: list[int]) -> Column:
    """Positions in a table of disk bytes; null for bytes that aren't in it."""
    back = {b: k for k, b in enumerate(table)}
    entries = F.array(*(F.lit(back.get(b)).cast("int") for b in range(256)))
    return F.transform(values, lambda x: F.get(entries, x))


def encode_g64(values: Column) -> Column:
    """Each byte as ten bits in two bytes, from the high bit on."""
    table = F.array(*(F.lit(x) for x in G64))

    def pair(x: Column) -> Column:
        high, low = F.get(table, F.shiftright(x, 4)), F.get(table, x.bitwiseAND(15))
        return F.array(F.shiftleft(high, 3).bitwiseOR(F.shiftright(low, 2)), F.shiftleft(low, 6).bitwiseAND(255))

    return F.flatten(F.transform(values, pair))


def fat12(values: Column) -> Column:
    """Twelve-bit entries packed two in three bytes; a last entry that isn't whole is left out."""

    def entries(v: Column) -> Column:
        def entry(n: Column) -> Column:
            at = n + F.floor(n / 2).cast("int")
            word = F.get(v, at) + 256 * F.get(v, at + 1)
            return F.when(n % 2 == 1, F.shiftright(word, 4)).otherwise(word.bitwiseAND(0xFFF))

        count = F.floor(F.size(v) * 2 / 3).cast("int")
        return F.when(F.size(v) < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), entry))

    return let(values, entries)


def fat12_sums(data: Column) -> Column:
    """(n, total, n_bad) of the entries of ``fat12``: how many, their sum, and those of 0xFF7. Null data has none.

    Works on Arrow batches in Python, which need this package.
    """

    @pandas_udf("n long, total long, n_bad long")
    def run(rows: pd.Series) -> pd.DataFrame:
        out = []
        for row in rows:
            v = np.frombuffer(row or b"", np.uint8).astype(np.int64)
            count = len(v) * 2 // 3 if len(v) > 1 else 0
            n = np.arange(count)
            at = n + n // 2
            word = v[at] + 256 * v[at + 1] if count else n
            entry = np.where(n % 2 == 1, word >> 4, word & 0xFFF)
            out.append((count, int(entry.sum()), int((entry == 0xFF7).sum())))
        return pd.DataFrame(out, columns=["n", "total", "n_bad"])

    return run(data)


def hex_rows(data: Column) -> Column:
    """(label, hex, plain, high): what the lines of a dump are cut of; see ``hex_row``."""
    shown = lambda low, high, by: F.encode(F.translate(latin(data), "".join(map(chr, range(256))), "".join(chr(x - by) if low <= x < high else "." for x in range(256))), "ISO-8859-1")
    digits = F.encode(F.regexp_replace(F.hex(data), "(..)", "$1 "), "ISO-8859-1")
    return F.struct(F.octet_length(data).alias("n"), digits.alias("digits"), shown(32, 127, 0).alias("plain"), shown(160, 255, 128).alias("high"))


def hex_row(n: Column, digits: Column, plain: Column, high: Column, row: Column) -> Column:
    """A dump line of 16 bytes: address, hex, then the bytes as ASCII and as ASCII with the high bit set. Slices of ``hex_rows``."""
    piece = lambda of, width: F.decode(F.substring(of, row * (16 * width) + 1, F.lit(16 * width)), "ISO-8859-1")
    blanks = F.greatest(16 - (n - row * 16), F.lit(0))
    label = F.lpad(F.hex(row * 16), 4, "0")
    return F.concat(label, F.lit(" : "), piece(digits, 3), F.repeat(F.lit("   "), blanks), F.lit("|+| "), piece(plain, 1), F.lit(" "), F.repeat(F.lit(" "), blanks), F.lit("|-| "), piece(high, 1))
