"""Language-model scores of documents: subword lattice likelihood.

The pieces and their ranks come from an existing vocabulary; the ranks give the first
weights (p ~ 1 / (rank + 10)) and one expectation step over all training words, each as often
as it is used, gives the final ones. A word's probability is the sum over all its
segmentations, by a forward recursion in log space, and a text's that of its words and its
end: score = sum over words of (log10 lattice + log10(1 - e)) + log10 e, with e the share of
training tokens that are ends.

With a ``concentration`` whole words share in the model, as pieces of their own: a word's
probability is its discounted share of the training words, and what the discount leaves goes
to the lattice, fitted to the distinct words. A text draws its words from an urn of so many
words by these probabilities, to which each drawn word is added, so a word that a text has
used is likelier to come again.

All counts are over the whole corpus and are aggregated by word in Spark. Only words with
at least ``COMMON`` of the training tokens are sent to every task; there are at most
1 / COMMON of them at any size of the corpus. All other words meet their counts in a
shuffle join on the word's 64-bit hash, one row for each document and word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .lattice import Lattice
from .storage import cut, ship

COMMON = 1e-6
#: Uses of all pieces together that no word accounts for, and the first log10 probability of a word's end.
PRIOR = 10.0
FIRST_STOP = math.log10(0.2)
#: Words in the urn that op8 draws from.
CONCENTRATION = 2000.0
_LN10 = math.log(10.0)
#: Distinct words that a task gathers before it sends their counts on.
GATHER = 400_000


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece model and first log10 weights from their scores (minus the rank)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [p for p, _ in found]
    rank = -np.array([s for _, s in found])
    weight = 1 / (rank - rank.min() + 10)
    return pieces, np.log10(weight / weight.sum())


def refitted(weights: np.ndarray, uses: np.ndarray, words: int) -> tuple[np.ndarray, float]:
    """log10 weights of the pieces and of a word's end, from uses; ``PRIOR`` uses go by the first weights, so none is 0."""
    uses = uses + np.power(10.0, weights) * PRIOR
    whole = uses.sum() + words + 1
    return np.log10(uses / whole), math.log10((words + 1) / whole)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0."""
    below, y = np.ones_like(x), x
    for _ in range(8):
        below, y = below * y, y + 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - np.log(below)


def drawn(score: np.ndarray, n: np.ndarray, concentration: float) -> np.ndarray:
    """log10 of an urn's part in n draws of a word with that log10 probability, without the size of the urn."""
    first = score + math.log10(concentration)
    share = np.power(10.0, first)
    return first + (log_gamma(share + n) - log_gamma(share + 1)) / _LN10


def _drawn(score: Column, n: Column, concentration: float) -> Column:
    """As ``drawn``."""
    first = score + math.log10(concentration)
    again = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda a, k: a + F.log10(k + F.pow(F.lit(10.0), first)))
    return first + F.when(n > 1, again).otherwise(0.0)


def discount(once: int, twice: int) -> float:
    """What is taken off each word's count, from the numbers of words that occur once and twice."""
    return (once + 1) / (once + 2 * twice + 2)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, word, c): uses in training texts; words of other texts come with 0."""
    seen: dict[int, list] = {}

    def flush():
        for k in range(0, len(keys := list(seen)), 10_000):
            part = keys[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([seen[h][0] for h in part], pa.string()), pa.array([seen[h][1] for h in part], pa.int64())], names=["h", "word", "c"])
        seen.clear()

    for batch in batches:
        train = batch.column("train").to_numpy(zero_copy_only=False)
        for row, words in textvec.chunks(batch.column("text")):
            use = train[row + words.row].astype(np.int64)
            distinct, first, which = np.unique(words.hashes().view(np.int64), return_index=True, return_inverse=True)
            total = np.bincount(which, use, len(distinct)).astype(np.int64)
            for h, i, c in zip(distinct.tolist(), first.tolist(), total.tolist(), strict=True):
                if h in seen:
                    seen[h][1] += c
                else:
                    seen[h] = [words.text(i), c]
            if len(seen) > GATHER:
                yield from flush()
    yield from flush()


def _expected(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        total = np.zeros(len(model.value[0]))
        for batch in batches:
            total += lattice.expected(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "n"])

    return run


def _lattice(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(lattice.score(batch.column("word").to_pylist()))], names=["h", "c", "lattice"])

    return run


_ROWS = "uid long, doc_id long, held_out boolean, h long, n int, n_tokens long, n_known long, base double, score double"


def _texts(common, end, concentration, goes_on):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, known, base, score = common.value
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            tokens, hits = np.ones(len(uid), np.int64), np.zeros(len(uid), np.int64)
            hits += end[0]
            base_of, score_of = np.full(len(uid), end[1]), np.full(len(uid), end[2])
            rare_row, rare_h, rare_n = [], [], []
            for row, words in textvec.chunks(batch.column("text")):
                h, to = words.hashes().view(np.int64), row + words.row
                tokens[row : row + words.rows] += np.diff(words.first)
                order = np.lexsort((h, to))
                h, to = h[order], to[order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (to[1:] != to[:-1])]) if len(h) else np.zeros(0, int)
                n, h, to = np.diff(np.r_[new, len(h)]), h[new], to[new]
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                at, where, times = at[hit], to[hit], n[hit]
                hits += np.bincount(where, known[at] * times, len(uid)).astype(np.int64)
                base_of += np.bincount(where, base[at] * times, len(uid))
                score_of += np.bincount(where, drawn(score[at], times, concentration) if concentration else score[at] * times, len(uid))
                rare_row.append(to[~hit])
                rare_h.append(h[~hit])
                rare_n.append(n[~hit])
            if concentration:
                words_of = tokens - 1
                score_of += words_of * goes_on - (log_gamma(concentration + words_of) - log_gamma(np.array(concentration))) / _LN10
            row = np.concatenate([np.arange(len(uid)), *rare_row])
            pad = np.zeros(len(row) - len(uid))
            own = textvec.mix(uid.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)
            columns = [
                pa.array(uid[row]), batch.column("doc_id").take(pa.array(row)), batch.column("held_out").take(pa.array(row)), pa.array(np.concatenate([own, *rare_h])), pa.array(np.concatenate([np.zeros(len(uid), int), *rare_n]).astype(np.int32)),
                *(pa.array(np.concatenate([x, pad.astype(x.dtype)])) for x in (tokens, hits, base_of, score_of)),
            ]
            for k in range(0, len(row), 20_000):
                yield pa.RecordBatch.from_arrays([c.slice(k, 20_000) for c in columns], names=[c.split()[0] for c in _ROWS.split(", ")])

    return run


def lm_scores(docs: DataFrame, model_path: str, concentration: float = 0.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs(doc_id, text)``.

    Texts whose crc32(doc_id as text) mod 10 is 0 are held out of all counts. A null text is
    empty: its only token is the end. A null doc_id counts as training. Repeated rows are
    counted and returned as often as they come. With a ``concentration`` of 0 the lattice alone scores. Without training texts the base is the
    smoothed one and the pieces have their first weights. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"), F.monotonically_increasing_id().alias("uid"))
    words = rows.select("text", (~F.col("held_out")).alias("train")).mapInArrow(_counts, "h long, word string, c long")
    table = cut(words.groupBy("h", "word").agg(F.sum("c").alias("c")))
    ends = rows.where(~F.col("held_out")).count()
    sums = table.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    total, kinds = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    below = total + 0.1 * (kinds + 1)
    end_share = (ends + 1) / (total + 2)

    pieces, weights = vocabulary(model_path)
    model = spark.sparkContext.broadcast((pieces, weights, FIRST_STOP))
    got = table.where("c > 0").select("word", (F.lit(1).cast("long") if concentration else F.col("c")).alias("c")).mapInArrow(_expected(model), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    uses = np.zeros(len(pieces))
    for r in got:
        uses[r["piece"]] = r["n"]
    model = spark.sparkContext.broadcast((pieces, *refitted(weights, uses, (sums["v"] or 0) if concentration else total - ends)))
    stats = table.select("h", "word", "c").mapInArrow(_lattice(model), "h long, c long, lattice double")
    goes_on = math.log10(1 - end_share)
    w_score = F.col("lattice") + goes_on
    if concentration:
        off = discount(sums["once"] or 0, sums["twice"] or 0)
        left = off * sums["v"] / (total - ends) if sums["v"] else 1.0
        w_score = F.when(F.col("c") == 0, F.col("lattice") + math.log10(left)).otherwise(F.log10((F.col("c") - off) / float(total - ends) + left * F.pow(F.lit(10.0), F.col("lattice"))) if sums["v"] else F.col("lattice"))
    stats = cut(stats.select("h", "c", F.log10((F.col("c") + 0.1) / below).alias("w_base"), w_score.alias("w_score")))

    common = stats.where(F.col("c") >= max(1.0, COMMON * total)).orderBy("h").toArrow().to_pydict() if total else {"h": [], "c": [], "w_base": [], "w_score": []}
    send = spark.sparkContext.broadcast((np.array(common["h"], np.int64), np.ones(len(common["h"])), np.array(common["w_base"], float), np.array(common["w_score"], float)))
    end = (int(ends > 0), math.log10((ends + 0.1) / below), math.log10(end_share))
    parts = rows.select("uid", "doc_id", "held_out", "text").mapInArrow(_texts(send, end, concentration, goes_on), _ROWS)
    rare = stats.where(F.col("c") < max(1.0, COMMON * total))
    met = parts.join(rare, "h", "left")
    n = F.col("n")
    of_word = _drawn(F.col("w_score"), n, concentration) if concentration else n * F.col("w_score")
    out = met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(F.col("c") > 0, n).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.coalesce(n * F.col("w_base"), F.lit(0.0))).alias("base_score"), F.sum(F.col("score") + F.coalesce(of_word, F.lit(0.0))).alias("score"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
