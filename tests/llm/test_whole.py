"""Cases that the operators once left out."""

import random

from fluxmere.llm import decontam, line_dedup

WORDS = [f"w{k}x" for k in range(300)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_item_with_swapped_halves(spark):
    rng = random.Random(8)
    docs, items, want = [], [], {}
    for k, n in enumerate((50, 60, 90, 120)):
        w = sentence(rng, n).split()
        items.append((k, " ".join(w)))
        swapped = " ".join(w[n // 2 :] + w[: n // 2])
        for j, (before, after) in enumerate(((33, 70), (0, 20), (25, 0), (0, 0))):
            docs.append((10 * k + j, " ".join([sentence(rng, before), swapped, sentence(rng, after)])))
            want[10 * k + j, k] = (before, round((n - 8) / n, 9))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.start_word, round(r.similarity, 9)) for r in got} == want


def near(spark, lines):
    """Numbers of the lines that go as near copies, each line a document."""
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in line_dedup.line_decisions(docs).where("kind = 'near'").collect())


def test_short_lines(spark):
    rng = random.Random(6)
    lines = [sentence(rng, n) for n in range(1, 13)]
    base = [line.split() for line in lines]
    lines += [" ".join(["new", *w[1:]]) for w in base]
    lines += [" ".join([*w, "end"]) for w in base]
    one_apart = lambda x, y: any(x[:i] + x[i + 1 :] == y[:i] + y[i + 1 :] for i in range(len(x))) if len(x) == len(y) else any(a[:i] + a[i + 1 :] == b for a, b in ((x, y), (y, x)) if len(a) == len(b) + 1 for i in range(len(a)))
    w = [line.split() for line in lines]
    want = [k for k in range(len(w)) if any(max(len(w[j]), len(w[k])) >= 4 and one_apart(w[j], w[k]) for j in range(k))]
    assert near(spark, lines) == want and len(want) == 19


def test_white_space(spark):
    rng = random.Random(7)
    base = [sentence(rng, n) for n in (1, 2, 5, 12, 30)]
    w = base[3].split()
    texts = ["\n".join(base), "\r\n".join(base) + "\r", "\n".join(f"  {x.replace(' ', '  ')}\t" for x in base), " ".join([*w[:4], "other", *w[5:]])]
    got = {r.doc_id: (r.n_exact, r.n_near) for r in line_dedup.line_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (0, 0), 1: (5, 0), 2: (5, 0), 3: (0, 1)}
