"""Small codes and rules: literals, versions, branches, marks, track numbers, merges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import let


def radix_literal(text: Column) -> Column:
    """Value of a ``$`` hexadecimal, ``%`` binary or decimal literal; ``_`` and blanks don't count; null for anything else."""
    bare = F.regexp_replace(text, "[_ ]", "")
    digits = F.substring(bare, 2, 20)
    return (
        F.when(bare.rlike("^[$][0-9A-Fa-f]{1,15}$"), F.conv(digits, 16, 10).cast("long"))
        .when(bare.rlike("^%[01]{1,62}$"), F.conv(F.substring(bare, 2, 62), 2, 10).cast("long"))
        .when(bare.rlike("^[0-9]{1,18}$"), bare.try_cast("long"))
    )


def version(text: Column) -> Column:
    """(major, minor, patch) of exactly X.Y.Z, which compares by number; null for anything else."""
    part = lambda k: F.split_part(text, F.lit("."), F.lit(k)).try_cast("int")
    return F.when(text.rlike("^[0-9]{1,9}[.][0-9]{1,9}[.][0-9]{1,9}$"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def branch_target(address: Column, offset: Column) -> Column:
    """Where a two-byte relative branch at an address goes: its byte counts from the next instruction, signed; null outside of 0 to 65535."""
    to = address + 2 + F.when(offset > 127, offset - 256).otherwise(offset)
    return F.when(to.between(0, 65535), to)


def branch_offset(address: Column, target: Column) -> Column:
    """The byte of such a branch; null if it doesn't reach."""
    by = target - address - 2
    return F.when(by.between(-128, 127), F.pmod(by, F.lit(256)))


def highest_bit(value: Column) -> Column:
    """1-based place of the highest bit that is set; 0 for 0."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value))).cast("long")


def track_of(cylinder: Column, head: Column, heads: int) -> Column:
    return cylinder * heads + head


def place_of(track: Column, heads: int) -> Column:
    """(cylinder, head)."""
    return F.struct(F.floor(track / heads).cast("long").alias("cylinder"), F.pmod(track, F.lit(heads)).cast("long").alias("head"))


def unescaped(text: Column) -> Column:
    r"""Hex digits of the bytes that an escaped text means: ``\xHH`` is a byte, other characters beyond ASCII are dropped."""
    # pieces between the marks are plain but for what is dropped; a piece behind a mark begins with its digits
    pieces = F.split(text, r"\\x(?=[0-9A-Fa-f]{2})")
    plain = lambda p: F.hex(F.encode(F.regexp_replace(p, r"[^\x00-\x7F]+", ""), "US-ASCII"))
    return F.array_join(F.transform(pieces, lambda p, k: F.when(k == 0, plain(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 2)), plain(F.substr(p, F.lit(3)))))), "")


def password_code(password: Column) -> Column:
    """(decoder, hex): the upper-cased password in 8 places, each byte XORed with the sum of all mod 256, stored last first."""
    padded = F.rpad(F.substring(F.upper(password), 1, 8), 8, " ")
    codes = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.ascii(F.substr(padded, k, F.lit(1))))

    def coded(of: Column) -> Column:
        total = F.pmod(F.aggregate(of, F.lit(0), lambda a, x: a + x), F.lit(256)).cast("int")
        return let(total, lambda d: F.struct(d.cast("long").alias("decoder"), F.array_join(F.transform(F.reverse(of), lambda x: F.lpad(F.hex(x.bitwiseXOR(d)), 2, "0")), "").alias("hex")))

    return let(codes, coded)


def mostly_copy(base: Column, over: Column) -> Column:
    """``over`` where it says something, else ``base``: null and empty say nothing."""
    return F.coalesce(F.nullif(over, F.lit("")), base)


def cut_at(data_hex: Column, terminator: str) -> Column:
    """Hex digits of bytes up to the first terminator (two digits), which starts at a byte."""
    pairs = F.regexp_extract_all(data_hex, F.lit(".."), F.lit(0))
    return let(pairs, lambda p: F.array_join(F.slice(p, 1, F.coalesce(F.nullif(F.array_position(p, terminator), F.lit(0)) - 1, F.size(p)).cast("int")), ""))
