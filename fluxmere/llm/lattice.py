"""Log-space forward recursion over all segmentations of words into vocabulary pieces.

Words of one length are handled together: numpy over words, a loop over positions and
piece lengths. Pieces are found by the hash of their code points. Words of more than ``LONG``
code points are taken one by one, with memory in proportion to their length.
"""

from __future__ import annotations

import math

import numpy as np

from . import textvec

MARK = "▁"
#: log10 weight of a code point that no piece covers.
STRAY = -9.0
LONG = 200
#: Code points of words of one length that are handled together.
_AT_ONCE = 100_000
_BASE = 0x9E3779B97F4A7C15
_LN10 = np.log(10.0)


class Lattice:
    """pieces: strings; weights: their log10 probabilities; stop: log10 probability of a word's end."""

    def __init__(self, pieces: list[str], weights: np.ndarray, stop: float):
        self.weights, self.stop = np.asarray(weights, float), stop
        self._pieces = dict(zip(pieces, range(len(pieces)), strict=True))
        self._by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._inverse_base = pow(_BASE, -1, 2**64)
        lengths = np.array([len(p) for p in pieces])
        for n in np.unique(lengths):
            which = np.flatnonzero(lengths == n)
            codes = np.array([[ord(c) for c in pieces[i]] for i in which], np.uint64)
            keys = self._sums(codes)[:, -1]
            order = np.argsort(keys)
            self._by_length[int(n)] = (keys[order], which[order])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def _sums(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum(textvec.mix(codes + np.uint64(17)) * self._powers(_BASE, codes.shape[1]), axis=1, out=out[:, 1:])
        return out

    def _arcs(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end, (begin, piece or -1 for a stray code point or -2 for none, log10 weight)."""
        sums, m = self._sums(codes), codes.shape[1]
        inverse = self._powers(self._inverse_base, m)
        out: list[list] = [[]]
        for end in range(1, m + 1):
            arcs = []
            for n, (keys, which) in self._by_length.items():
                if n > end:
                    continue
                h = (sums[:, end] - sums[:, end - n]) * inverse[end - n]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                if n == 1 or hit.any():
                    piece = np.where(hit, which[at], -1 if n == 1 else -2)
                    arcs.append((end - n, piece, np.where(hit, self.weights[which[at]], STRAY if n == 1 else -np.inf)))
            out.append(arcs)
        return out

    def _forward(self, arcs: list, words: int) -> np.ndarray:
        total = np.full((len(arcs), words), -np.inf)
        total[0] = 0
        for end in range(1, len(arcs)):
            paths = np.stack([total[begin] + w for begin, _, w in arcs[end]])
            best = paths.max(axis=0)
            total[end] = best + np.log10(np.power(10.0, paths - best).sum(axis=0))
        return total

    def _groups(self, words: list[str]):
        size = np.array([len(w) for w in words])
        for n in np.unique(size[size <= LONG]):
            which = np.flatnonzero(size == n)
            step = max(1, _AT_ONCE // (n + 1))
            for k in range(0, len(which), step):
                part = which[k : k + step]
                text = "".join(MARK + words[i] for i in part)
                yield part, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(part), n + 1).astype(np.uint64)

    def _steps(self, text: str, end: int):
        """(begin, piece or -1, log10 weight) of the pieces of one text that end there."""
        for n in self._by_length:
            piece = self._pieces.get(text[end - n : end], -1) if n <= end else -1
            if piece >= 0:
                yield end - n, piece, float(self.weights[piece])
            elif n == 1:
                yield end - 1, -1, STRAY

    @staticmethod
    def _sum(logs: list[float]) -> float:
        best = max(logs)
        return best + math.log10(sum(10.0 ** (x - best) for x in logs))

    def _ahead(self, text: str) -> list[float]:
        total = [0.0]
        for end in range(1, len(text) + 1):
            total.append(self._sum([total[begin] + w for begin, _, w in self._steps(text, end)]))
        return total

    def score(self, words: list[str]) -> np.ndarray:
        """log10 of the summed probability of all segmentations of each word."""
        out = np.zeros(len(words))
        for part, codes in self._groups(words):
            out[part] = self._forward(self._arcs(codes), len(part))[-1] + self.stop
        for i, word in enumerate(words):
            if len(word) > LONG:
                out[i] = self._ahead(MARK + word)[-1] + self.stop
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over the words, each taken as often as counted."""
        out = np.zeros(len(self.weights))
        for part, codes in self._groups(words):
            arcs = self._arcs(codes)
            ahead = self._forward(arcs, len(part))
            m = len(arcs) - 1
            back = np.full((m + 1, len(part)), -np.inf)
            back[m] = 0
            for end in range(m, 0, -1):
                for begin, _, w in arcs[end]:
                    back[begin] = np.logaddexp(back[begin] * _LN10, (w + back[end]) * _LN10) / _LN10
            for end in range(1, m + 1):
                for begin, piece, w in arcs[end]:
                    share = np.power(10.0, ahead[begin] + w + back[end] - ahead[m]) * counts[part]
                    ok = piece >= 0
                    out += np.bincount(piece[ok], share[ok], len(out))
        for i, word in enumerate(words):
            if len(word) > LONG:
                text = MARK + word
                ahead, m = self._ahead(text), len(text)
                back = [-math.inf] * m + [0.0]
                for end in range(m, 0, -1):
                    for begin, piece, w in self._steps(text, end):
                        if piece >= 0:
                            out[piece] += 10.0 ** (ahead[begin] + w + back[end] - ahead[m]) * counts[i]
                        one = w + back[end]
                        back[begin] = one if back[begin] == -math.inf else self._sum([back[begin], one])
        return out
