"""Benchmark decontamination: documents that hold a benchmark item, or nearly so.

A window of a document that is as long as an item is held against the item. Only documents
with at least the share of the item's shingles that the wanted similarity implies go on.
There a window may start at any word, whatever the order of the item's parts in it. Moved to
the right over words where no shingle of the item stands, a window loses nothing, so it is
enough to start at each such shingle (or as late as a whole window can), and only where so
many of them follow within the window as the similarity takes. Besides, windows start where
the item would if the shingle stood in its place; only these may be cut off by the end of
the document. Such windows and the items
get 64-bit SimHash fingerprints. With a radius of ``RADIUS`` the fingerprint is cut into
RADIUS + 1 blocks: two fingerprints within the radius agree on a block at least, so a join
on (item, block, value) finds all of them. What is within the radius is decided by the
exact weighted Jaccard similarity of the shingle multisets.

At a similarity of 0.8 the expected distance is 10 bits with a deviation of 3, so the radius
leaves five deviations. No lossless block index selects much at such a radius: blocks of two
or three bits agree by chance as a rule. So candidates come from the shingles, which lose
nothing, and the fingerprints save exact comparisons of windows.

All steps are built-in expressions. The benchmark's shingles are sent to all tasks only
after a count has shown them few; else they are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, unused
from .storage import cut, sent_if_small

RADIUS = 24
SHINGLE = 5


def _words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; none if there are fewer."""
    run = lambda x, i: F.xxhash64(F.lit(size), x, *(F.get(words, i + k) for k in range(1, size)))
    return F.slice(F.transform(words, run), 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))


def _word_shingles(text: Column, size: int) -> Column:
    return let(_words(text), lambda w: _shingles(w, size))


def simhash(hashes: Column) -> Column:
    """64 bits, each the majority of that bit over the hashes; ties give 0."""
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.when(F.getbit(h, b) == 1, 1).otherwise(0))
    bit = lambda b: F.when(2 * ones(b) > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """(block, value) of radius + 1 blocks that make up the fingerprint."""
    n = radius + 1
    edges = [64 * k // n for k in range(n + 1)]
    part = lambda a, b: F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
    return F.array(*(F.struct(F.lit(k).alias("block"), part(edges[k], edges[k + 1]).alias("value")) for k in range(n)))


def _common(x: Column, y: Column) -> Column:
    """Size of the intersection of two multisets: each common value once, and what is common beyond that of the few that repeat."""
    again = lambda a: let(F.sort_array(a), lambda s: F.filter(s, lambda h, i: F.coalesce(h == F.get(s, i - 1), F.lit(False))))
    count = lambda a, h: F.size(F.filter(a, lambda z: z == h))
    beyond = lambda p: F.aggregate(F.array_distinct(p.y), F.lit(0), lambda n, h: n + F.least(count(p.x, h), count(p.y, h)))
    return F.size(F.array_intersect(x, y)) + let(F.struct(again(x).alias("x"), again(y).alias("y")), beyond)


def _starts(percent: int) -> Column:
    """Where windows start, from ``total`` (words of the document), ``hits`` (places of the item's shingles), ``aligned``, ``m``, ``n`` and ``size``."""
    last = F.greatest(F.col("total") - F.col("n"), F.lit(0))
    full = F.least(F.col("m"), F.col("total") - F.col("size") + 1)
    need = F.ceil(F.lit(percent) * (F.col("m") + full) / F.lit(100 + percent)).cast("int")

    def slid(known: Column) -> Column:
        at_last = F.get("hits", F.size("hits") - known.need) >= known.last
        inner = F.filter("hits", lambda p, i: (p < known.last) & (F.get("hits", i + known.need - 1) < p + known.full))
        return F.concat(inner, F.when(at_last, F.array(known.last)).otherwise(F.array().cast("array<int>")))

    return F.array_distinct(F.concat("aligned", let(F.struct(last.alias("last"), full.alias("full"), need.alias("need")), slid)))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the best window of each document for each item that it holds.

    docs(doc_id, text), benchmark(item_id, text); 100 * |intersection| >= percent * |union| of
    the multisets of five-word shingles (an item of fewer words is one shingle) in windows of
    the item's number of words. Of equally good windows the first is given. Null and wordless
    texts hold nothing and are held by nothing; rows that repeat an id count as one document
    or item; null ids are left out. Other columns are ignored. Empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("words")).where("item_id is not null and size(words) > 0").dropDuplicates(["item_id"])
    items = items.withColumns({"n": F.size("words"), "size": F.least(F.size("words"), F.lit(SHINGLE))})
    grams = F.lit(None)
    for s in range(SHINGLE, 0, -1):
        grams = F.when(F.col("size") == s, _shingles(F.col("words"), s)) if s == SHINGLE else grams.when(F.col("size") == s, _shingles(F.col("words"), s))
    items = cut(items.select("item_id", "n", "size", grams.alias("grams")))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [SHINGLE]
    known = cut(items.select("item_id", "size", F.size("grams").alias("m"), F.posexplode("grams").alias("off", "h")))

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = None
    for s in sizes:
        each = text.select("doc_id", F.posexplode(_word_shingles(F.col("text"), s)).alias("pos", "h"))
        met = each.join(sent_if_small(known.where(F.col("size") == s)), "h").select("doc_id", "item_id", "m", "off", "pos")
        found = met if found is None else found.unionByName(met)
    found = cut(found.distinct())
    enough = found.select("doc_id", "item_id", "m", "off").distinct().groupBy("doc_id", "item_id", "m").agg(F.count("*").alias("hits")).where(F.col("hits") * 100 >= F.col("m") * percent)
    places = found.join(enough.select("doc_id", "item_id"), ["doc_id", "item_id"])
    places = places.groupBy("doc_id", "item_id", "m").agg(F.array_sort(F.collect_set("pos")).alias("hits"), F.collect_set(F.greatest(F.col("pos") - F.col("off"), F.lit(0))).alias("aligned"))
    places = cut(places.join(items.select("item_id", "n", "size"), "item_id"))

    held = text.join(sent_if_small(cut(places.select("doc_id").distinct())), "doc_id", "left_semi")
    cases = held.select("doc_id", _words(F.col("text")).alias("words")).join(places, "doc_id")
    grams = None
    for k in sizes:
        grams = F.when(F.col("size") == k, _shingles(F.col("words"), k)) if grams is None else grams.when(F.col("size") == k, _shingles(F.col("words"), k))
    cases = cases.select("doc_id", "item_id", "m", "n", "size", "hits", "aligned", F.size("words").alias("total"), grams.alias("all"))
    cases = cases.select("doc_id", "item_id", "m", "n", "total", "all", F.explode(_starts(percent)).alias("start"))
    cases = cut(cases.select("doc_id", "item_id", "start", F.least("n", F.col("total") - F.col("start")).alias("n_words"), F.slice("all", F.col("start") + 1, F.col("m")).alias("grams")).where("size(grams) > 0"))

    print_of = items.select("item_id", "grams", simhash(F.col("grams")).alias("print"))
    marked = cases.withColumn("print", simhash(F.col("grams")))
    left = cut(marked).withColumn("b", F.explode(blocks(F.col("print"), radius)))
    right = cut(print_of).select("item_id", F.col("grams").alias("item_grams"), F.col("print").alias("item_print"), F.explode(blocks(F.col("print"), radius)).alias("b"))
    near = left.join(right, ["item_id", "b"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    near = near.select("doc_id", "item_id", "start", "n_words", "grams", "item_grams").distinct()
    both = near.withColumn("both", _common(F.col("grams"), F.col("item_grams")))
    union = F.size("grams") + F.size("item_grams") - F.col("both")
    good = both.withColumn("total", union).where(F.col("both") * 100 >= F.col("total") * percent)
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("both") / F.col("total")).alias("similarity"), (-F.col("start")).alias("at"), "n_words")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.at")).cast("long").alias("start_word"), F.col("best.n_words").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns. A null doc_id is kept."""
    name = unused("contaminated_doc", docs)
    bad = sent_if_small(cut(contaminated(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()))
    return docs.join(bad, docs["doc_id"].cast("long") == bad[name], "left_anti")
