"""Character sets, file names and patterns of old file systems, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import byte_list, latin, utf8


def _unix(text: Column) -> Column:
    """CR LF as LF."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def escaped_ascii(data: Column, escape_controls: bool = True, inverted: bool = False) -> Column:
    """Bytes as ASCII, those outside the bounds as \\xHH; inverted bytes have the high bit set."""
    low, high = (0x20, 0x7E) if escape_controls else (0x00, 0x7F)
    shift = 128 if inverted else 0
    # the bytes that are shown are moved in one scan; each other one that occurs is replaced in another
    shown = range(low + shift, high + shift + 1)
    stays = "".join(map(chr, shown))
    hidden = F.array_distinct(F.split(F.translate(latin(data), stays, ""), ""))
    code = lambda c: F.concat(F.lit("\\x"), F.lpad(F.hex(F.ascii(c)), 2, "0"))
    escape = lambda text, c: F.when(c == "", text).otherwise(F.replace(text, c, code(c)))
    if not inverted:
        return F.aggregate(hidden, latin(data), escape)
    one = lambda x: F.when((x >= low + shift) & (x <= high + shift), F.chr((x - shift).cast("long"))).otherwise(F.concat(F.lit("\\x"), F.lpad(F.hex(x.cast("long")), 2, "0")))
    return F.array_join(F.transform(byte_list(data), one), "")


def _ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def to_dos(text: Column) -> Column:
    """High-bit ASCII bytes (array<int>) with CR ends of line; null for text that isn't ASCII."""
    one = lambda x: F.when(x.isin(10, 13), 0x8D).otherwise(x + 128)
    return F.when(_ascii_only(text), F.transform(byte_list(utf8(_unix(text))), one))


def from_dos(values: Column) -> Column:
    """Text of high-bit ASCII; bytes without the bit become NUL."""
    one = lambda x: F.when(x == 0x8D, F.lit("\n")).when(x > 127, F.chr((x - 128).cast("long"))).otherwise(F.decode(F.unhex(F.lit("00")), "utf-8"))
    return F.array_join(F.transform(values, one), "")


def to_cpm(text: Column) -> Column:
    """ASCII bytes (array<int>) with CR LF ends of line; null for text that isn't ASCII."""
    one = lambda x: F.when(x.isin(10, 13), F.array(F.lit(13), F.lit(10))).otherwise(F.array(x))
    return F.when(_ascii_only(text), F.flatten(F.transform(byte_list(utf8(_unix(text))), one)))


def from_cpm(data: Column) -> Column:
    """Text up to the first 0x1A, without CR; bytes over 127 become NUL."""
    up_to = F.substring_index(latin(data), "\x1a", 1)
    plain = F.translate(up_to, "".join(map(chr, range(128, 256))) + "\r", "\x80" * 128)
    return F.replace(plain, F.lit("\x80"), F.decode(F.unhex(F.lit("00")), "utf-8"))


def nul_count(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.decode(F.unhex(F.lit("00")), "utf-8"), F.lit("")))).cast("long")


def unpack_kind(data: Column) -> Column:
    """text if decoding leaves no NUL, else binary."""
    return F.when(nul_count(from_cpm(data)) == 0, "text").otherwise("binary")


#: Name patterns by file system.
NAME_PATTERNS = {
    "fat": r"^[A-Z0-9!#$%&'()@^_`{}~-]{1,8}(\.[A-Z0-9!#$%&'()@^_`{}~-]{0,3})?$",
    "prodos": r"^[A-Z][A-Z0-9.]{0,14}$",
}


def name_valid(name: Column, system: str) -> Column:
    """Lower case counts as upper case."""
    return F.upper(name).rlike(NAME_PATTERNS[system])


def wildcard_pattern(pattern: str) -> str:
    """LIKE pattern (escape !) over base padded to 8 and type padded to 3; a star fills its part and has to end it."""
    base, _, rest = pattern.upper().partition(".")
    out = ""
    for part, width in ((base, 8), (rest.partition(".")[0], 3)):
        star = part.find("*")
        if star >= 0 and star != len(part) - 1 or len(part.rstrip("*")) > width:
            raise ValueError(f"not a file name pattern: {pattern}")
        part = part[:star].ljust(width, "?") if star >= 0 else part.ljust(width)
        out += "".join("_" if c == "?" else f"!{c}" if c in "%_!" else c for c in part)
    return out


def wildcard_match(base: Column, extension: Column, pattern: str) -> Column:
    """An empty pattern matches all; . and .. match nothing else; parts that are too long match nothing."""
    if not pattern:
        return F.lit(True)
    name = F.concat(F.rpad(F.upper(base), 8, " "), F.rpad(F.upper(extension), 3, " "))
    fits = (F.length(base) <= 8) & (F.length(extension) <= 3) & ~base.isin(".", "..")
    return fits & F.like(name, F.lit(wildcard_pattern(pattern)), F.lit("!"))


def glob_regex(pattern: str, separator: bool = True) -> str:
    """Anchored regular expression; with ``separator`` a star or question mark doesn't cross a slash, two stars do."""
    out, k = "", 0
    one = "[^/]" if separator else "."
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if pattern.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "[" and (end := pattern.find("]", k + 2)) > 0:
            inner = pattern[k + 1 : end]
            out, k = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]", end + 1
            continue
        if c == "{" and (end := pattern.find("}", k)) > 0:
            out, k = out + "(?:" + "|".join(glob_regex(p, separator)[1:-1] for p in pattern[k + 1 : end].split(",")) + ")", end + 1
            continue
        out, k = out + (one + "*" if c == "*" else one if c == "?" else re.escape(c)), k + 1
    return f"^{out}$"


def glob(name: Column, pattern: str, separator: bool = True, case_sensitive: bool = False) -> Column:
    """The literal head of the pattern is tested first, so scans can push it down when case counts."""
    if not case_sensitive:
        name, pattern = F.upper(name), pattern.upper()
    head = re.match(r"[^*?\[{]*", pattern).group()
    found = name.rlike(glob_regex(pattern, separator))
    return name.startswith(head) & found if head else found


def catalog_row(kind: Column, blocks: Column, name: Column) -> Column:
    return F.format_string("%-4s %5d  %s", kind, blocks, name)


def column_format(parts: Column, widths: tuple[int, int, int] = (9, 6, 11)) -> Column:
    """Source columns padded to widths, a space at least after each; a comment is moved past the columns that are missing."""
    width = lambda k: F.coalesce(F.get(F.array(*(F.lit(w) for w in widths)), k), F.lit(1))
    skipped = lambda k: F.coalesce(F.get(F.array(*(F.lit(sum(widths[j:])) for j in range(3))), k), F.lit(0))
    one = lambda c, k: F.concat(F.repeat(F.lit(" "), F.when(c.startswith(";"), skipped(k)).otherwise(0)), c, F.repeat(F.lit(" "), F.greatest(F.lit(1), width(k) - F.octet_length(c))))
    return F.rtrim(F.array_join(F.transform(parts, one), ""))
