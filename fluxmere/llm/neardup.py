"""MinHash near-duplicate documents with tensored banding.

``GROUPS`` small collections of ``PER_GROUP`` minhashes are computed once; the key of a
table is a *pair* of collections, so 12 x 2 minhashes serve 66 tables of 4 minhashes. At a
similarity of 0.8 two sets miss all tables with a probability of 1e-4, as at least two of
twelve collections have to agree. Every candidate is confirmed on the full shingle sets.

Skew. Documents with the same shingle set form a class and only its representative goes
on, so thousands of copies cost one row each. Members of a table's bucket are first held
against the bucket's smallest class only (a star, linear in the bucket). Buckets whose
members are then still in more than one component are taken further. For those with more
than ``WIDE`` members the shingles that no other such document has are counted; they are in
no intersection, which bounds every similarity from above. The member with the least share
of them, as a rule the text that the others were made from, is the centre of a second star,
and members that no other can reach by the bound are left out. The pairs that are not
connected yet and that the bound allows are then compared, each in the first table that it
shares. No partner, candidate or bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .columns import let
from .components import components
from .storage import SENT_ROWS, cut, gathered, sent_if_small, settled, ship

GROUPS = 12
PER_GROUP = 2
WIDE = 8
_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(1, 2**63, GROUPS * PER_GROUP, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(1, 2**63, GROUPS * PER_GROUP, dtype=np.uint64)
#: Bytes of shingle sets that leave a Python worker at once.
SET_BYTES = 1 << 20
#: Classes with more than one in so many of all documents are met by a broadcast, of at most as many rows.
HOT = 20_000


def _collections(grams: np.ndarray) -> np.ndarray:
    """The collections' 64-bit keys: minhashes of a non-empty set, folded by collection."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(grams), 4096):
        part = grams[k : k + 4096, None] * _A + _B
        least = np.minimum(least, part.min(axis=0))
    least = least.reshape(GROUPS, PER_GROUP)
    out = np.zeros(GROUPS, np.uint64)
    for k in range(PER_GROUP):
        out = textvec.mix(out * np.uint64(0x2545F4914F6CDD1D) + least[:, k])
    return out


def _grams(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, words in textvec.chunks(column):
        hashes = words.hashes()
        for r in range(words.rows):
            yield textvec.shingles(hashes[words.first[r] : words.first[r + 1]], size)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "f1", "f2", *(f"c{k}" for k in range(GROUPS))]
        for batch in batches:
            n = batch.num_rows
            out = np.zeros((n, 3 + GROUPS), np.uint64)
            for i, grams in enumerate(_grams(batch.column("text"), size)):
                if len(grams):
                    out[i, 0] = len(grams)
                    out[i, 1] = grams.sum(dtype=np.uint64)
                    out[i, 2] = np.bitwise_xor.reduce(textvec.mix(grams + np.uint64(1)))
                    out[i, 3:] = _collections(grams)
            out = out.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[:, k]) for k in range(out.shape[1]))], names=names)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(first: int, sets: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.slice(first, len(sets)), pa.array(sets, pa.binary())], names=["id", "grams"])

        for batch in batches:
            ids, held, sets = batch.column("doc_id"), 0, []
            for i, grams in enumerate(_grams(batch.column("text"), size)):
                sets.append(grams.tobytes())
                held += len(sets[-1])
                if held > SET_BYTES:
                    yield out(i + 1 - len(sets), sets)
                    held, sets = 0, []
            yield out(batch.num_rows - len(sets), sets)

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("ga"), batch.column("gb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both) > 0
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _grams_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, grams in enumerate(_grams(batch.column("text"), size)):
                own = np.full(len(grams), batch.column("doc_id")[i].as_py(), np.int64)
                for k in range(0, len(grams), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(grams[k : k + 20_000].view(np.int64)), pa.array(own[k : k + 20_000])], names=["h", "class"])

    return run


def _histograms(size: int):
    """Shingles by their hash's first bits; null where a count is too large for the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.bincount(grams >> np.uint64(56), minlength=256) for grams in _grams(batch.column("text"), size)]
            counts = [x.astype(np.int16) if x.max() < 1 << 15 else None for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.list_(pa.int16()))], names=["class", "shape"])

    return run


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``ids(doc_id)``; ids that a count shows to be few go to the texts, not the texts to them."""
    ids = cut(ids)
    n = ids.count()
    ids = gathered(ids, n)
    found = docs.join(F.broadcast(ids) if n <= SENT_ROWS else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return gathered(found, n, 2000)


def _links(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the checkpointed ``pairs(a, b)`` whose full sets are alike enough, with the texts read again for their documents only."""
    n = pairs.count()
    pairs = gathered(pairs, n)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = cut(_texts_of(docs, ids).mapInArrow(_sets(size), "id long, grams binary"))
    wide = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    return cut(gathered(wide.mapInArrow(_confirm(percent), "a long, b long"), n, 2000))


def _private(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(class, private): shingles of each class that no other of ``classes(class)`` has, where there are any."""
    grams = _texts_of(docs, classes.select(F.col("class").alias("doc_id"))).mapInArrow(_grams_of(size), "h long, class long")
    alone = grams.groupBy("h").agg(F.count("*").alias("n"), F.min("class").alias("class")).where("n = 1")
    return alone.groupBy("class").agg(F.count("*").alias("private"))


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """``members(key, class, ...)`` of the buckets that hold more than one component, with the component."""
    named = members.join(label.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    split = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return named.join(split, "key", "left_semi")


def _first_table(x: Column, y: Column) -> Column:
    """Number of the first table that two documents share, from arrays of their collections: a pair is made there only."""
    agree = F.zip_with(x, y, lambda p, q: p == q)
    return let(F.array_position(agree, True).cast("int"), lambda j: let(j + F.array_position(F.slice(agree, j + 1, GROUPS), True).cast("int") - 1, lambda i: (i * (i - 1) / 2).cast("int") + j - 1))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs(doc_id, text)``.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of
    ``size``-word shingles (A-Z lower-cased). A text of fewer words is one shingle; a null,
    empty or blank text has an empty set and is linked with nothing. ``component_id`` is the
    smallest doc_id reachable over links. A repeated row is returned as often as it comes and
    does not link a document with others; rows that share a doc_id count as one document. A
    null doc_id stays null and links with nothing. Other columns are ignored. An empty table
    gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ship(docs.sparkSession)
    keys = [f"c{k}" for k in range(GROUPS)]
    base = cut(docs.mapInArrow(_signatures(size), "doc_id long, n_shingles long, f1 long, f2 long, " + ", ".join(f"{k} long" for k in keys)))
    of = ["n_shingles", "f1", "f2"]
    classes = cut(base.where("n_shingles > 0 and doc_id is not null").groupBy(*of).agg(F.min("doc_id").alias("class"), F.count("*").alias("documents"), *(F.first(k).alias(k) for k in keys)))
    tables = [(i, j) for i in range(GROUPS) for j in range(i)]
    buckets = classes.select("class", "n_shingles", F.posexplode(F.array(*(F.xxhash64(F.lit(n), f"c{i}", f"c{j}") for n, (i, j) in enumerate(tables)))).alias("t", "key"))
    shared = buckets.groupBy("key").agg(F.min("class").alias("a"), F.min_by("n_shingles", "class").alias("na"), F.count("*").alias("members")).where("members > 1")
    met = settled(buckets.join(shared, "key"))
    like = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    star = settled(met.where((F.col("a") != F.col("class")) & like(F.col("na"), F.col("n_shingles"))).select("a", F.col("class").alias("b")).distinct())
    links = _links(docs, star, size, percent)
    label = components(links)

    rows = ["key", "t", "class", "n_shingles"]
    left = settled(_open(met.where("members > 2").select(*rows, "members"), label))
    narrow = left.where(F.col("members") <= WIDE).withColumn("common", F.col("n_shingles"))
    wide = left.where(F.col("members") > WIDE)
    if wide.limit(1).count():
        ids = settled(wide.select("class", "n_shingles").distinct())
        common = F.col("n_shingles") - F.coalesce("private", F.lit(0))
        facts = ids.join(_private(docs, ids, size), "class", "left").select("class", common.alias("common")).where(F.col("common") * 100 >= F.col("n_shingles") * percent)
        facts = settled(facts)  # those that another may be like at all
        wide = settled(wide.drop("component").join(sent_if_small(facts), "class"))
        order = F.struct(F.col("common") / F.col("n_shingles"), -F.col("class"))
        hubs = wide.groupBy("key").agg(F.max_by(F.struct("class", "n_shingles"), order).alias("hub"))
        again = wide.join(hubs, "key").where((F.col("hub.class") != F.col("class")) & like(F.col("hub.n_shingles"), F.col("n_shingles")))
        again = again.select(F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")).distinct()
        again = settled(again.join(star, ["a", "b"], "left_anti"))
        links, star = links.unionByName(_links(docs, again, size, percent)), star.unionByName(again)
        label = components(links)
        # |x & y| is at most the common shingles of either and has to be percent of the union; so too the sum of the lesser counts of two histograms
        can = lambda x, nx, ny: x * (100 + percent) >= (nx + ny) * percent
        least = F.greatest(F.col("least"), F.ceil(F.col("n_shingles") * percent / 100))
        able = wide.join(wide.groupBy("key").agg(F.min("n_shingles").alias("least")), "key").where(can(F.col("common"), F.col("n_shingles"), least)).drop("least")
        shapes = _texts_of(docs, facts.select(F.col("class").alias("doc_id"))).mapInArrow(_histograms(size), "class long, shape array<short>")
        able = settled(_open(able, label)).join(shapes, "class", "left")
        narrow = narrow.withColumn("shape", F.lit(None).cast("array<short>")).unionByName(able.select(*narrow.columns, "shape"))
    else:
        narrow = narrow.withColumn("shape", F.lit(None).cast("array<short>"))
    narrow = narrow.join(classes.select("class", F.array(*keys).alias("c")), "class")
    x, y = narrow.alias("x"), narrow.alias("y")
    enough = lambda both: F.coalesce(both * (100 + percent) >= (F.col("x.n_shingles") + F.col("y.n_shingles")) * percent, F.lit(True))
    lesser = F.aggregate(F.zip_with("x.shape", "y.shape", lambda a, b: F.least(a, b)), F.lit(0), lambda a, n: a + n)
    held = enough(F.least("x.common", "y.common")) & enough(lesser)
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.component") != F.col("y.component")) & like(F.col("x.n_shingles"), F.col("y.n_shingles")) & (_first_table(F.col("x.c"), F.col("y.c")) == F.col("x.t")) & held)
    rest = settled(rest.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).join(star, ["a", "b"], "left_anti"))
    more = _links(docs, rest, size, percent)
    if more.limit(1).count():
        label = components(links.unionByName(more))

    known = cut(classes.join(label.select(F.col("node").alias("class"), "component"), "class", "left").select(*of, "documents", F.coalesce("component", "class").alias("component_id")))
    narrow = base.select("doc_id", *of)
    rest = narrow.where("n_shingles > 0 and doc_id is not null")
    level = max(base.count() // HOT, 1000)
    hot = known.where(F.col("documents") > level).drop("documents")  # at most HOT rows
    if hot.limit(1).count():
        hot, known = F.broadcast(hot), known.where(F.col("documents") <= level)
        met = rest.join(hot, of).unionByName(rest.join(hot, of, "left_anti").join(known.drop("documents"), of))
    else:
        met = rest.join(known.drop("documents"), of)
    alone = narrow.where("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    found = met.unionByName(alone.select(*met.columns))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
