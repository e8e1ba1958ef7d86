"""Counterfactual-regularised toxicity classifier.

Logistic regression over the distinct features of a text: its words without outer
punctuation and their prefixes. The loss adds ``fairness`` times the squared change of the
logit between a labelled sentence and copies in which identity terms are swapped for
others, so a neutral mention of a group cannot carry weight of its own. The terms are a
parameter; ``IDENTITY`` has some in four languages. Labelled rows without one are not swapped.

The fit uses at most ``max_rows`` labelled documents (a documented parameter: those with the
least hash of doc_id, one row each) on the driver, in the order of doc_id, so it does not
depend on partitions; scoring is a map over all texts with a weight table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .storage import cut, ship

PREFIXES = (4, 5, 6, 7, 8, None)
BITS = 22
#: Copies of a sentence made for each identity term in it.
SWAPS = 3
#: Fixed: names of groups in English, German, French and Spanish.
IDENTITY = tuple(
    (
        "women men woman man girls boys muslims christians jews hindus buddhists atheists muslim christian jewish hindu buddhist atheist gay lesbian straight "
        "bisexual transgender trans queer black white asian african latino hispanic arab european american mexican chinese indian russian german french "
        "spanish british irish italian turkish polish immigrants refugees foreigners natives migrants disabled deaf blind elderly old young poor rich "
        "frauen männer muslime christen juden hindus atheisten schwule lesben schwarze weiße ausländer flüchtlinge einwanderer behinderte "
        "femmes hommes musulmans chrétiens juifs athées gays lesbiennes noirs blancs étrangers réfugiés immigrés handicapés "
        "mujeres hombres musulmanes cristianos judíos ateos lesbianas negros blancos extranjeros refugiados inmigrantes discapacitados"
    ).split()
)
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _trimmed(words: textvec.Words) -> textvec.Words:
    """The words without ASCII punctuation at their ends, where something is left."""
    start, end = words.start.copy(), words.end.copy()
    more = np.ones(len(start), bool)
    while more.any():
        left = more & (end - start > 1) & _PUNCT[words.data[np.minimum(start, len(words.data) - 1)]]
        start += left
        right = more & (end - start > 1) & _PUNCT[words.data[end - 1]]
        end -= right
        more = left | right
    words.start, words.end = start, end
    return words


def _features(words: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature slot and row of each word and prefix; a word as short as the prefix has none."""
    slots, rows = [], []
    for n, prefix in enumerate(PREFIXES):
        keep = np.ones(len(words.start), bool) if prefix is None else words.end - words.start > prefix
        h = textvec.mix(words.hashes(prefix)[keep] + np.uint64(n + 1))
        slots.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(words.row[keep])
    return np.concatenate(slots), np.concatenate(rows)


def _gather(identity: tuple[str, ...]):
    """Distinct feature slots of each labelled text, and the identity terms that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = {h: k for k, h in enumerate(_term_hashes(identity))}
        for batch in batches:
            slots: list = [None] * batch.num_rows
            found: list = [None] * batch.num_rows
            for row, words in textvec.chunks(batch.column("text")):
                words = _trimmed(words)
                slot, of = _features(words)
                both = np.unique((of.astype(np.int64) << BITS) | slot)
                own = words.hashes().view(np.int64)
                bounds = np.searchsorted(both, np.arange(words.rows + 1, dtype=np.int64) << BITS)
                for r in range(words.rows):
                    slots[row + r] = (both[bounds[r] : bounds[r + 1]] & ((1 << BITS) - 1)).astype(np.int32)
                    found[row + r] = sorted({terms[h] for h in own[words.first[r] : words.first[r + 1]].tolist() if h in terms})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(slots, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "slots", "terms"])

    return run


def _term_words(identity: tuple[str, ...]) -> Iterator[textvec.Words]:
    for term in identity:
        yield next(textvec.chunks(pa.array([term])))[1]


def _term_hashes(identity: tuple[str, ...]) -> list[int]:
    return [int(words.hashes().view(np.int64)[0]) for words in _term_words(identity)]


def _term_slots(identity: tuple[str, ...]) -> list[np.ndarray]:
    return [np.unique(_features(words)[0]) for words in _term_words(identity)]


def fit(toxic: np.ndarray, slots: list[np.ndarray], terms: list[list[int]], identity: tuple[str, ...] = IDENTITY, fairness: float = 1.0, ridge: float = 3e-4, rounds: int = 300, apart_by: float = 4.0, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights of all slots, and the bias. Features of fewer than 3 texts, or less than ``apart_by`` standard errors apart between the labels, are left out. Without a row: weights 0, score 0.1."""
    size = 1 << BITS
    n = len(toxic)
    if not n:
        return np.zeros(size, np.float32), float(np.log(0.1 / 0.9))
    of_term, rng = _term_slots(identity), np.random.Generator(np.random.PCG64(seed))
    cols, rows = np.concatenate(slots), np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in slots])
    count, with_label = np.bincount(cols, minlength=size), np.bincount(cols, toxic[rows], size)
    ones = max(int(toxic.sum()), 1)
    share = count / n
    apart = np.abs(with_label / ones - (count - with_label) / max(n - ones, 1)) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / max(n - ones, 1)))
    used = (count >= 3) & (apart >= apart_by)
    keep = used[cols]
    ids = np.cumsum(used) - 1
    cols, rows = ids[cols[keep]], rows[keep]
    d = int(used.sum())
    pair_at, pair_to, change = [], [], []  # logit(x) - logit(swapped) = sum of change * weight
    k = 0
    for r in range(n):
        for term in terms[r]:
            for other in rng.choice(len(identity), min(SWAPS, len(identity)), replace=False):
                for s, sign in ((of_term[term], 1.0), (of_term[other], -1.0)):
                    s = s[used[s]]
                    pair_at.append(np.full(len(s), k)), pair_to.append(ids[s]), change.append(np.full(len(s), sign))
                k += 1
    at, to, by = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((pair_at, np.int64), (pair_to, np.int64), (change, float)))
    y = toxic.astype(float)
    w, bias = np.zeros(d), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m = v = np.zeros(d + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], n) + bias
        err = (1 / (1 + np.exp(-z)) - y) / n
        g = np.bincount(cols, err[rows], d) + ridge * w
        if k:
            moved = np.bincount(at, by * w[to], k)
            g += 2 * fairness / k * np.bincount(to, by * moved[at], d)
        g = np.append(g, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    out = np.zeros(size, np.float32)
    out[used] = w
    return out, float(bias)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, bias = model.value
        table = np.zeros(1 << BITS, np.float32)
        table[slots] = weights
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for row, words in textvec.chunks(batch.column("text")):
                slot, of = _features(_trimmed(words))
                hit = table[slot] != 0
                both = np.unique((of[hit].astype(np.int64) << BITS) | slot[hit])
                z[row : row + words.rows] += np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], words.rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, threshold: float = 0.3, identity: tuple[str, ...] = IDENTITY, fairness: float = 1.0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs(doc_id, text)``, learnt from ``labels(doc_id, toxic)``.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out of the fit. A null text is empty
    and gets the score of the bias; a null doc_id is not held out. Null labels are ignored.
    Repeated rows are returned as often as they come. Other columns, of whatever name, are
    not read. Of a doc_id that repeats in docs the greatest text is learnt from, and label 1
    wins over 0. Without labels each score is 0.1.
    """
    spark = docs.sparkSession
    ship(spark)
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    chosen = chosen.where(~held("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = cut(chosen)  # at most max_rows narrow rows, so it may be sent to all tasks
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    got = rows.mapInArrow(_gather(identity), "doc_id long, toxic int, slots array<int>, terms array<int>").toArrow().sort_by("doc_id")
    weights, bias = fit(got.column("toxic").to_numpy(), [x.values.to_numpy() for x in got.column("slots")], got.column("terms").to_pylist(), identity, fairness)
    used = np.flatnonzero(weights)
    model = spark.sparkContext.broadcast((used, weights[used], bias))
    scored = docs.select("doc_id", held("doc_id").alias("held_out"), "text").mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
