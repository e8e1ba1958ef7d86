"""Line-numbered BASIC programs as linked token lines, and back.

A line is the address of the next one, its number, its bytes and a 0; an address 0 ends the
program. Outside strings, remarks and data, blanks are dropped, letters are upper-cased and
keywords are replaced by one byte, the first of the table that fits at a place.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Fixed: keywords in the order of their codes, from 0x80.
TOKENS = (
    "END FOR NEXT DATA INPUT DEL DIM READ GR TEXT PR# IN# CALL PLOT HLIN VLIN HGR2 HGR HCOLOR= HPLOT DRAW XDRAW HTAB HOME ROT= SCALE= SHLOAD TRACE NOTRACE NORMAL INVERSE FLASH "
    "COLOR= POP VTAB HIMEM: LOMEM: ONERR RESUME RECALL STORE SPEED= LET GOTO RUN IF RESTORE & GOSUB RETURN REM STOP ON WAIT LOAD SAVE DEF POKE PRINT CONT LIST CLEAR GET NEW "
    "TAB( TO FN SPC( THEN AT NOT STEP + - * / ^ AND OR > = < SGN INT ABS USR FRE SCRN( PDL POS SQR RND LOG EXP COS SIN TAN ATN PEEK LEN STR$ VAL ASC CHR$ LEFT$ RIGHT$ MID$"
).split()
START = 2049
MOST_LINES, MOST_CHARS = 5000, 255
_DATA, _REM, _PRINT, _AT = (0x80 + TOKENS.index(x) for x in ("DATA", "REM", "PRINT", "AT"))
_BY_FIRST: dict[str, list[tuple[int, str]]] = {}
for _k, _word in enumerate(TOKENS):
    _BY_FIRST.setdefault(_word[0], []).append((_k, _word))
_NUMBER, _RAW, _ENDS = re.compile(r"\s*([0-9][0-9 ]*)"), re.compile(r"(?i)rem|data"), re.compile(r"\r?\n")
#: Pieces of lines between strings that a worker remembers.
PIECES = 4096
_PLAIN = re.compile(rb"[ -\[\]-~]*")
_ESCAPE = re.compile(rb"\\x([0-9A-Fa-f]{2})")


def _unescaped(raw: str) -> bytes:
    if "\\" not in raw:
        return raw.encode("ascii", "ignore")
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), raw.encode("ascii", "ignore"))


def _keyword(text: str, at: int) -> tuple[int, int] | None:
    """Code and end of the keyword at a place, blanks within it skipped. AT gives way to ATN and to A TO."""
    for k, word in _BY_FIRST.get(text[at].upper(), ()):
        end = at
        for char in word:
            while end < len(text) and text[end] == " ":
                end += 1
            if end >= len(text) or text[end].upper() != char:
                break
            end += 1
        else:
            after = text[end:].lstrip(" ")[:1].upper()
            if 0x80 + k == _AT and after in ("N", "O"):
                continue
            return 0x80 + k, end
    return None


def _data_end(text: str, at: int) -> int:
    quoted = False
    while at < len(text) and (quoted or text[at] != ":"):
        quoted ^= text[at] == '"'
        at += 1
    return at


@lru_cache(PIECES)
def _code(text: str) -> tuple[bytes, int]:
    """The bytes of a piece of a line without strings up to DATA or REM, and where it goes on raw after that; -1 for neither."""
    out, at = bytearray(), 0
    while at < len(text):
        char = text[at]
        if char == " ":
            at += 1
        elif char == "?":
            out.append(_PRINT)
            at += 1
        elif found := _keyword(text, at):
            code, at = found
            out.append(code)
            if code in (_DATA, _REM):
                return bytes(out), at
        else:
            out += char.upper().encode("ascii", "ignore")
            at += 1
    return bytes(out), -1


def line_tokens(text: str) -> bytes:
    """The bytes of a line's statements."""
    out, at = bytearray(), 0
    while at < len(text):
        if text[at] == '"':
            end = text.find('"', at + 1)
            end = len(text) if end < 0 else end + 1
            out += _unescaped(text[at:end])
            at = end
            continue
        end = text.find('"', at)
        end = len(text) if end < 0 else end
        piece, raw = _code(text[at:end])
        out += piece
        if raw >= 0:
            at += raw
            end = len(text) if piece[-1] == _REM else _data_end(text, at)
            out += _unescaped(text[at:end])
        at = end
    return bytes(out)


def tokenize(program: str, start: int = START) -> bytes:
    """Linked lines of a program, in the order given; blank lines are skipped. ValueError for a line without a number or with one above 63999."""
    out, address = bytearray(), start
    for line in _ENDS.split(program):
        if not line.strip():
            continue
        found = _NUMBER.match(line)
        number = int(found[1].replace(" ", "")) if found else -1
        if not 0 <= number <= 63999:
            raise ValueError(f"bad line number in {line!r}")
        rest = line[found.end() :]
        kept = rest.rstrip() if rest.count('"') % 2 == 0 and not _RAW.search(rest) else rest
        body = line_tokens(kept)
        address += len(body) + 5
        out += address.to_bytes(2, "little") + number.to_bytes(2, "little") + body + b"\0"
    return bytes(out) + b"\0\0"


def _escaped(raw: bytes) -> str:
    if _PLAIN.fullmatch(raw):
        return raw.decode("ascii")
    safe = re.sub(rb"\\(?=x[0-9A-Fa-f]{2})", rb"\\x5c", raw)
    return "".join(chr(c) if 32 <= c < 127 else f"\\x{c:02x}" for c in safe)


@lru_cache(PIECES)
def _shown(data: bytes) -> tuple[str, int]:
    """The listing of a piece of a line without strings up to DATA or REM, and where it goes on raw after that; -1 for neither."""
    text = ""
    for k, code in enumerate(data):
        if code >= 0x80:
            text += f" {TOKENS[code - 0x80]} " if code - 0x80 < len(TOKENS) else f"\\x{code:02x}"
            if code in (_DATA, _REM):
                return text, k + 1
        else:
            text += chr(code)
    return text, -1


def detokenize(data: bytes) -> str:
    """The listing: keywords between blanks, and what can't be shown escaped. ValueError for more than ``MOST_LINES`` lines or ``MOST_CHARS`` bytes in one."""
    out, at, lines = [], 0, 0
    while at + 1 < len(data) and (data[at] or data[at + 1]):
        lines += 1
        number = int.from_bytes(data[at + 2 : at + 4], "little")
        at += 4
        end = data.find(b"\0", at)
        end = len(data) if end < 0 else end
        if lines > MOST_LINES or end - at > MOST_CHARS:
            raise ValueError("program too long")
        text = f"{number} "
        while at < end:
            if data[at] == 0x22:
                at += 1
                close = data.find(b'"', at, end)
                close = end if close < 0 else close + 1
                text += '"' + _escaped(data[at:close])
                at = close
                continue
            close = data.find(b'"', at, end)
            close = end if close < 0 else close
            piece, raw = _shown(data[at:close])
            text += piece
            if raw >= 0:
                at += raw
                close = end if data[at - 1] == _REM else at + _data_end(data[at:end].decode("latin-1"), 0)
                text += _escaped(data[at:close])
            at = close
        out.append(text + "\n")
        at = end + 1
    return "".join(out)


def tokens(program: Column, start: int = START) -> Column:
    """Binary; null for a null program and for one that can't be tokenised."""

    @pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else tokenize(text, start)
            except ValueError:
                return None

        return texts.map(one)

    return run(program)


def listing(data: Column) -> Column:
    """Text; null for null data and for what is no program."""

    @pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def one(row):
            try:
                return None if row is None else detokenize(bytes(row))
            except ValueError:
                return None

        return rows.map(one)

    return run(data)
