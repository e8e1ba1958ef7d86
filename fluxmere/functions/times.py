"""Packed dates and times of old file systems; timestamps are without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _word(*parts: Column) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("long")


def prodos_pack(ts: Column) -> tuple[Column, Column]:
    """(date word, time word): the year has two digits."""
    return _word(F.day(ts), F.month(ts) * 32, F.year(ts) % 100 * 512), _word(F.minute(ts), F.hour(ts) * 256)


def prodos_unpack(date: Column, time: Column) -> Column:
    """Years 1979 to 2078; null if a part is out of range."""
    short = F.shiftright(date, 9)
    year = F.when(short < 79, 2000 + short).otherwise(1900 + short).cast("int")
    month, day = F.shiftright(date, 5).bitwiseAND(15).cast("int"), date.bitwiseAND(31).cast("int")
    return _stamp(year, month, day, F.shiftright(time, 8).bitwiseAND(255).cast("int"), time.bitwiseAND(255).cast("int"), F.lit(0))


def _stamp(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, day, hour, minute, second)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def pascal_pack(ts: Column) -> Column:
    return _word(F.month(ts), F.day(ts) * 16, F.year(ts) % 100 * 512)


def pascal_unpack(date: Column) -> Column:
    """Always in the twentieth century; null if invalid."""
    zero = F.lit(0)
    return _stamp((1900 + F.shiftright(date, 9)).cast("int"), date.bitwiseAND(15).cast("int"), F.shiftright(date, 4).bitwiseAND(31).cast("int"), zero, zero, zero)


def cpm_pack(ts: Column) -> tuple[Column, Column, Column]:
    """(day number from 1978-01-01 as 1, hour, minute), the latter two as BCD. Before that day 0; at most 65535."""
    days = F.datediff(ts, F.lit("1978-01-01").cast("date"))
    number = F.when(days < 0, 0).otherwise(F.least(days + 1, F.lit(65535))).cast("long")
    bcd = lambda v: (F.floor(v / 10) * 16 + v % 10).cast("long")
    return number, bcd(F.hour(ts)), bcd(F.minute(ts))


def cpm_unpack(number: Column, hour: Column, minute: Column) -> Column:
    day = F.date_add(F.lit("1978-01-01").cast("date"), (number - 1).cast("int"))
    plain = lambda v: (v.bitwiseAND(15) + 10 * F.shiftright(v, 4)).cast("int")
    return _stamp(F.year(day), F.month(day), F.day(day), plain(hour), plain(minute), F.lit(0))


def fat_pack(ts: Column) -> tuple[Column, Column, Column]:
    """(date word, time word of two-second steps, tenths with the odd second as ten). Years are kept within 1980 and 2107."""
    year = F.greatest(F.least(F.year(ts), F.lit(2107)), F.lit(1980))
    second = F.second(ts)
    date = _word(F.day(ts), F.month(ts) * 32, (year - 1980) * 512)
    time = _word(F.floor(second / 2), F.minute(ts) * 32, F.hour(ts) * 2048)
    tenth = F.floor(F.date_format(ts, "SSS").cast("int") / 100)
    return date, time, _word(tenth, second % 2 * 10)


def fat_unpack(date: Column, time: Column, tenths: Column) -> Column:
    """Null for the zero date and for parts out of range."""
    part = lambda v, shift, mask: F.shiftright(v, shift).bitwiseAND(mask).cast("int")
    found = _stamp(1980 + part(date, 9, 127), part(date, 5, 15), part(date, 0, 31), part(time, 11, 31), part(time, 5, 63), part(time, 0, 31) * 2 + F.floor(tenths / 10).cast("int"))
    return F.when(date != 0, found)
