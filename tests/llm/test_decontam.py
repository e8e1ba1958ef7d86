"""Decontamination against brute force over random documents, and its edge cases."""

import random
from collections import Counter

import pytest

from fluxmere.llm import decontam

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def grams(w, size):
    return Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def brute(docs, items):
    """Best similarity of a window of the item's length, for each document and item with 0.8 or more."""
    out = {}
    for d, text in docs:
        for i, item in items:
            doc, it = (text or "").split(), (item or "").split()
            if not it or d is None:
                continue
            size = min(5, len(it))
            want = grams(it, size)
            best = 0
            for at in range(max(1, len(doc) - len(it) + 1)):
                have = grams(doc[at : at + len(it)], size)
                both = sum((have & want).values())
                best = max(best, both / max(1, sum(have.values()) + sum(want.values()) - both))
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        k = rng.randrange(len(w))
        rng.choice([lambda: w.insert(k, "new"), lambda: w.pop(k), lambda: w.__setitem__(k, "other")])()
    return w


@pytest.mark.parametrize("seed", range(2))
def test_every_leak_is_found(spark, seed):
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(n) for n in (3, 12, 60, 100, 150, 200, 60)]
    items.append([rng.choice("abc") for _ in range(60)])
    docs = []
    for k in range(120):
        item = rng.choice(items)
        body = rng.choice([lambda: edited(rng, item, rng.randint(0, 3)), lambda: item[len(item) // 2 :] + item[: len(item) // 2], lambda: item + item, lambda: item[: len(item) * 3 // 4]])()
        docs.append((k, " ".join(text(rng.randint(0, 80)) + body + text(rng.randint(0, 80)))))
    bench = [(k, " ".join(w)) for k, w in enumerate(items)]
    found = decontam.contaminated(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(bench, ITEMS)).collect()
    got, want = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found}, brute(docs, bench)
    assert len(got) == len(found) and len(want) > 60
    assert {k: v for k, v in got.items() if k in want} == got
    assert {k: got.get(k) for k in want} == want


def test_halves_in_another_order(spark):
    a, b = [f"a{k}" for k in range(100)], [f"b{k}" for k in range(100)]
    docs = [(1, " ".join([f"x{k}" for k in range(50)] + b + a)), (2, " ".join(b[:60] + a[:60]))]
    found = decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, " ".join(a + b))], ITEMS)).collect()
    assert [(r.doc_id, r.item_id, r.start_word, r.n_words) for r in found] == [(1, 7, 50, 200)] and abs(found[0].similarity - 192 / 200) < 1e-9


def test_edges(spark):
    item = " ".join(f"w{k}" for k in range(40))
    long = " ".join(f"z{k}" for k in range(30_000)) + " " + item
    docs = spark.createDataFrame([(1, item, 5, "p"), (1, item, 6, "q"), (2, None, 7, "r"), (None, item, 8, "s"), (3, "", 9, "t"), (4, long, 10, "u"), (5, item + " " + item, 11, "v"), (6, "clean words", 12, "w")], DOCS + ", contaminated_doc int, Item_id string")
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, item, 0), (None, item, 0), (3, None, 0), (4, "", 0)], ITEMS + ", doc_id int")
    found = sorted((r.doc_id, r.item_id, r.start_word) for r in decontam.contaminated(docs, bench).collect())
    assert found == [(1, 1, 0), (1, 2, 0), (4, 1, 30_000), (4, 2, 30_000), (5, 1, 0), (5, 2, 0)]
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.contaminated_doc for r in left.collect()) == [7, 8, 9, 12]
    assert decontam.contaminated(docs, bench.limit(0)).count() == decontam.contaminated(docs.limit(0), bench).count() == 0
