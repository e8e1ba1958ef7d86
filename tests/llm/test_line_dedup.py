"""Line deduplication against brute force over random lines, and its edge cases."""

import random
import re

import pytest

from fluxmere.llm import line_dedup

SCHEMA = "doc_id long, text string"


def apart(a, b):
    """Word edit distance of at most 1, but not 0."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    lines = sorted((-1 if d is None else d, k, line.split()) for d, t in set(rows) for k, line in enumerate(re.split("\n", t or "")) if line.split())
    out = {}
    for i, (d, k, w) in enumerate(lines):
        earlier = [x for _, _, x in lines[:i]]
        if w in earlier:
            out[d, k] = "exact"
        elif any(apart(w, x) and max(len(w), len(x)) >= 4 for x in earlier):
            out[d, k] = "near"
    return out


def got(spark, rows):
    found = line_dedup.line_decisions(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    out = {(-1 if r.doc_id is None else r.doc_id, r.line_no): r.kind for r in found}
    assert len(found) == len(out)
    return out


def edited(rng, w):
    w, k = list(w), rng.randrange(len(w))
    what = rng.randrange(4)
    if what == 0:
        w[k] = rng.choice("xyz")
    elif what == 1:
        w.insert(rng.randrange(len(w) + 1), rng.choice("xyz"))
    elif what == 2 and len(w) > 1:
        del w[k]
    return w


@pytest.mark.parametrize("seed", range(3))
def test_all_and_only_near_lines(spark, seed):
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))] for _ in range(40)]
    pool += [edited(rng, rng.choice(pool)) for _ in range(160)]
    pool += [["q"] * n for n in range(3, 14)] + [["a", "b", "c", "d", "e"], ["b", "a", "d", "c", "e", "f"]]
    rows = [(d, rng.choice(["\n", "\r\n"]).join(rng.choice([" ", "  ", "\t"]).join(w) for w in rng.sample(pool, 6)) + rng.choice(["", "\n", "\n \n"])) for d in range(30)]
    assert got(spark, rows) == brute(rows) != {}


def test_edges(spark):
    nine = "one two three four five six seven eight nine"
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(None, nine), (1, "ten " + nine), (1, "ten " + nine), (2, None), (3, ""), (4, long), (5, long + " more"), (6, "a b c"), (7, "a b c"), (8, "a b d"), (9, "a b c d")]
    assert got(spark, rows) == brute(rows) == {(1, 0): "near", (5, 0): "near", (7, 0): "exact", (9, 0): "near"}
    assert got(spark, [(1, None)]) == {}
    assert line_dedup.line_decisions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_columns_keep_their_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", 1, 2, 3, 4), (2, "x\na b c d", 5, 6, 7, 8), (None, None, 9, 9, 9, 9)], SCHEMA + ", gone_doc int, Gone_lines int, kind int, line_no int")
    left = line_dedup.dedup_lines(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.where("doc_id > 0").collect())) == [(1, "a b c d", 1, 2, 3, 4), (2, "x", 5, 6, 7, 8)]
    assert left.count() == 3


def test_lines_of_one_repeated_word(spark):
    """No key is shared by lines of different words, so work grows with their number."""
    rows = [(k, " ".join([f"q{k}"] * 10)) for k in range(600)] + [(1000 + k, " ".join([f"q{k}"] * 11)) for k in range(600)]
    assert got(spark, rows) == {(1000 + k, 0): "near" for k in range(600)}
