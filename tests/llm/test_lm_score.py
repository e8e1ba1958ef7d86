"""The lattice against all segmentations, and document scores against a model fitted in plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import public_tokenizers
from fluxmere.llm import lattice, lm_score

MARK = lattice.MARK


def segmentations(text, weight):
    """(pieces, probability) of every way to cut the text; a code point that is no piece counts as a stray one."""
    if not text:
        yield [], 1.0
    for n in range(1, len(text) + 1):
        p = weight.get(text[:n], 10**lattice.STRAY if n == 1 else 0)
        if p:
            for rest, q in segmentations(text[n:], weight):
                yield [text[:n], *rest], p * q


@pytest.fixture
def small():
    rng = random.Random(1)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)} | {MARK, MARK + "a", MARK + "bc", "a"})
    return dict(zip(pieces, np.random.default_rng(2).uniform(0.001, 0.05, len(pieces)), strict=True))


def test_all_segmentations(small, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcz") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["a", "ü"]
    counts = np.array([rng.randint(1, 5) for _ in words], float)
    want, uses = [], Counter()
    for word, c in zip(words, counts, strict=True):
        found = list(segmentations(MARK + word, small))
        whole = sum(p for _, p in found)
        want.append(math.log10(whole * 0.3))
        for cut, p in found:
            for piece in cut:
                uses[piece] += c * p / whole
    for long in (200, 3):  # grouped, and one by one
        monkeypatch.setattr(lattice, "LONG", long)
        model = lattice.Lattice(list(small), np.log10(list(small.values())), math.log10(0.3))
        assert np.allclose(model.score(words), want)
        assert np.allclose(model.expected(words, counts), [uses[p] for p in small])


def test_very_long_word(small):
    model = lattice.Lattice(list(small), np.log10(list(small.values())), 0.0)
    score = model.score(["abc" * 20_000])[0]
    assert math.isfinite(score) and score < -1000


def test_document_scores(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["the", "Cat", "sat", "on", "mat", "zyx", "naïve"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "unheard-of words", "x" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "the cat"), (4, texts[4])], "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS h").repartition(3)
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [*enumerate(texts), (None, "the cat"), (4, texts[4])]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    low = lambda t: (t or "").lower().split()
    count = Counter(w for d, t in rows if not held(d) for w in low(t))
    ends = sum(not held(d) for d, _ in rows)
    pieces, weights = lm_score.vocabulary(path)
    words = list(count)
    uses = lattice.Lattice(pieces, weights, lm_score.FIRST_STOP).expected(words, np.array([count[w] for w in words], float))
    model = lattice.Lattice(pieces, *lm_score.refitted(weights, uses, sum(count.values())))
    end = (ends + 1) / (sum(count.values()) + ends + 2)
    got = lm_score.lm_scores(docs, path).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        tokens = low(by[r.doc_id])
        want = float(np.sum(model.score(tokens))) + len(tokens) * math.log10(1 - end) + math.log10(end) if tokens else math.log10(end)
        assert abs(r.score - want) < 1e-6 * max(1, abs(want))
        assert r.n_tokens == len(tokens) + 1 and r.held_out == held(r.doc_id)


def test_scores_with_whole_words(spark):
    """The urn drawn word by word in plain Python; held-out texts of training words are not far below the base."""
    rng = random.Random(11)
    names = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(5, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(names) for _ in range(rng.randint(1, 80))) for _ in range(300)] + [None, "", "new words new ones", "ab " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path = public_tokenizers.path("piece_bpe_32k.model")
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    count = Counter(w for d, t in enumerate(texts) if not held(d) for w in (t or "").split())
    total, ends = sum(count.values()), sum(not held(d) for d in range(len(texts)))
    pieces, weights = lm_score.vocabulary(path)
    words = list(count)
    uses = lattice.Lattice(pieces, weights, lm_score.FIRST_STOP).expected(words, np.ones(len(words)))
    model = lattice.Lattice(pieces, *lm_score.refitted(weights, uses, len(words)))
    off = lm_score.discount(*(sum(c == k for c in count.values()) for k in (1, 2)))
    end = (ends + 1) / (total + ends + 2)

    def share(word):
        return (max(count[word] - off, 0) + off * len(count) * 10 ** float(model.score([word])[0])) / total

    got = {r.doc_id: r for r in lm_score.lm_scores(docs, path, 50.0).collect()}
    assert len(got) == len(texts)
    for d, text in enumerate(texts):
        want, seen = math.log10(end), Counter()
        for k, word in enumerate((text or "").split()):
            want += math.log10(1 - end) + math.log10((50 * share(word) + seen[word]) / (50 + k))
            seen[word] += 1
        assert abs(got[d].score - want) < 1e-6 * abs(want)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 1.1 * sum(r.base_score for r in out) > sum(r.score for r in lm_score.lm_scores(docs, path).where("held_out").collect())
