"""Byte-level BPE ids of many texts at once.

The pre-tokens are found with numpy over code points, each distinct one is encoded once by
the tokenizers library, and the ids are gathered. Which code points are letters, numbers and
white space is asked of the library's own pre-tokenizer. The ids are those of encoding every
text by itself; a text that holds a special string of the vocabulary is encoded as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from . import textvec

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Distinct pre-tokens that a worker remembers, and characters that it works on at once.
CACHE = 1_000_000
CHUNK = 1 << 19
#: A longer text is cut between a word's last letter and a blank before the next word, where a pre-token always ends.
PART_CHARS = 500_000
_CUT = re.compile("[A-Za-z](?= [A-Za-z])")
#: Fixed: white space of the Unicode standard.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PROBES = {LETTER: "a", NUMBER: "1", OTHER: "!"}
#: Planes beyond have no letters or numbers.
_PLANES = [*range(0x40000), *range(0xE0000, 0xE1000)]


@lru_cache(maxsize=4)
def classes(path: str) -> bytes:
    """The class of each code point: that of the probe which the vocabulary's pre-tokenizer joins with it, else white space."""
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    table = bytearray(0x110000)
    for code in _PLANES:
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        kind = unicodedata.category(char)[0]
        likely = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
        for guess in (likely, *_PROBES):
            if len(split(_PROBES[guess] + char)) == 1:
                table[code] = guess
                break
        else:
            table[code] = SPACE
    return bytes(table)


def starts(codes: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; bounds: where texts begin, and the end."""
    n = len(codes)
    kind = classes[codes]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    white = kind == SPACE
    before_white = np.zeros(n, bool)
    before_white[1:] = white[:-1]
    before_white &= ~edge[:n]
    before_kind = np.full(n, 255, np.uint8)
    before_kind[1:] = kind[:-1]
    blank = np.zeros(n, bool)
    blank[1:] = codes[:-1] == 32
    blank &= ~edge[:n]
    start = edge[:n] | ((kind != before_kind) & ~before_white) | (before_white & ~blank)
    start = np.where(white, edge[:n] | ~before_white, start)
    ahead = np.zeros(n, bool)  # the last white space before something else begins a token
    ahead[:-1] = ~white[1:]
    ahead &= ~edge[1:]
    start |= white & ahead
    quote = np.flatnonzero((codes == 39) & start)
    if len(quote):
        room = bounds[np.searchsorted(bounds, quote, "right")] - quote
        one = np.where(room > 1, codes[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(room > 2, codes[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for found, size in ((quote[short], 2), (quote[long & ~short], 3)):
            start[found + 1] = False
            after = found + size
            after = after[after < n]
            start[after[kind[after] != SPACE]] = True
    return np.flatnonzero(start)


def parts(text: str) -> Iterator[str]:
    """A text in parts whose ids, one after another, are its own."""
    at = 0
    while len(text) - at > PART_CHARS and (found := _CUT.search(text, at + PART_CHARS)):
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


class Encoder:
    """Of a tokenizers file with a byte-level pre-tokenizer, and the classes that go with it."""

    def __init__(self, path: str, kinds: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, added))) if added else None
        self._classes = np.frombuffer(kinds, np.uint8)
        weight = np.random.Generator(np.random.PCG64(99)).integers(1, 2**63, 4096, dtype=np.uint64)
        self._weight = textvec.mix(np.arange(0x110000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + weight[np.arange(0x110000) % 4096])
        self._clear()

    def _clear(self) -> None:
        self._hash = np.zeros(0, np.uint64)  # of the known pre-tokens, sorted, and which one each is
        self._slot = np.zeros(0, np.int32)
        self._flat = np.zeros(0, np.uint32)
        self._at = np.zeros(1, np.int64)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, null as empty."""
        held: list[str] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            nonlocal size
            yield from self._chunk(held)
            held.clear()
            size = 0

        for text in texts:
            text = text or ""
            if len(text) > PART_CHARS or self._special and self._special.search(text):
                yield from flush()
                if self._special and self._special.search(text):
                    yield np.array(self._plain([text])[0], np.uint32)
                else:
                    yield np.concatenate([ids for part in parts(text) for ids in self._chunk([part])])
                continue
            held.append(text)
            size += len(text)
            if size > CHUNK:
                yield from flush()
        yield from flush()

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        bounds = np.cumsum([0, *map(len, texts)])
        text = "".join(texts)
        if not text:
            return [np.zeros(0, np.uint32) for _ in texts]
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin = starts(codes, bounds, self._classes)
        end = np.append(begin[1:], len(codes))
        power, inverse = textvec._powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self._weight[codes] * power[: len(codes)], out=sums[1:])
        hashes = textvec.mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._hash) > CACHE:
            self._clear()
        at = np.searchsorted(self._hash, distinct)
        old = np.zeros(len(distinct), bool)
        inside = at < len(self._hash)
        old[inside] = self._hash[at[inside]] == distinct[inside]
        slots = np.zeros(len(distinct), np.int64)
        slots[old] = self._slot[at[old]]
        if not old.all():
            slots[~old] = len(self._slot) + np.arange(np.count_nonzero(~old))
            ids = self._plain([text[begin[i] : end[i]] for i in first[~old]])
            self._hash = np.insert(self._hash, at[~old], distinct[~old])
            self._slot = np.insert(self._slot, at[~old], slots[~old])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._flat = np.concatenate([self._flat, np.fromiter((x for part in ids for x in part), np.uint32, int(sizes.sum()))])
            self._at = np.concatenate([self._at, self._at[-1] + np.cumsum(sizes)])
        slot = slots[which]
        size = self._at[slot + 1] - self._at[slot]
        upto = np.concatenate([[0], np.cumsum(size)])
        out = self._flat[np.repeat(self._at[slot] - upto[:-1], size) + np.arange(upto[-1])]
        cuts = upto[np.searchsorted(begin, bounds, "left")]
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str, kinds: bytes) -> Encoder:
    """One for all tasks of a worker, with what it remembers; kinds come compressed."""
    return Encoder(path, zlib.decompress(kinds))
