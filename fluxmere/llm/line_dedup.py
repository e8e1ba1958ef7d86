"""Line deduplication across documents: exact, and within one word edit.

A line is dropped if an earlier line (by doc_id, then line number) has the same words (white
space around and between them does not count, so CRLF equals LF), or,
if the longer of the two has at least ``LEAST_WORDS`` words, is one word apart: a word
replaced, put in or left out. The earliest stays. Lines without a word are never dropped.

Equal lines meet by a 128-bit hash of their words. Near lines meet by their deletion
neighbourhoods: for each word of a line the line without it, as a hashed key. Lines of equal
length that share a key for the same position differ in that word only, all of them from
each other, so such a group is reduced to its earliest member and never paired. A line whose
own words equal another's key is that line with a word left out. These keys hold the counted
words and the outer two, so they are all but unique and the join has about a row for each
line. The edit distance is then checked on the words.

To keep neighbourhoods from being made for all lines, a coarse one comes first: an edit
leaves the first or the second half of a line as it was. A line has the hashes of its first
and last n // 2 and (n - 1) // 2 words, so lines of n and of n or n + 1 words that are one
edit apart agree on one. Only lines that share such a hash go on. Lines of under
``HALF_WORDS`` words all go on, as a half of theirs says little. Nothing is collected, capped
or sampled. Lines that make up more than one in ``HOT`` of all are met by a broadcast of at
most ``HOT`` rows, so that their copies aren't sent to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import GAP, let, unused
from .storage import cut, sent_if_small, table

#: In lines of fewer words one word is too large a share for near copies.
LEAST_WORDS = 4
HALF_WORDS = 8
HOT = 20_000
_BLANKS = " \t\n\x0b\x0c\r"
PLACE = ("doc_id", "line_no")


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS)) != ""


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, ws) of the lines with a word."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return df.withColumn("line", F.btrim("line", F.lit(_BLANKS))).where("line <> ''").select(*PLACE, F.split("line", GAP).alias("ws"))


def _one_apart(x: Column, y: Column) -> Column:
    """Whether two word lists are one word edit apart."""
    differ = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda p, q: p != q), lambda d: d))

    def shorter(a: Column, b: Column) -> Column:  # b is a without a word
        first = F.array_position(F.zip_with(a, b, lambda p, q: ~p.eqNullSafe(q)), True)
        return let(first, lambda k: F.slice(a, (k + 1).cast("int"), F.size(a)) == F.slice(b, k.cast("int"), F.size(a)))

    n = F.size(x) - F.size(y)
    return F.when(n == 0, differ(x, y) == 1).when(n == 1, shorter(x, y)).when(n == -1, shorter(y, x)).otherwise(F.lit(False))


def _halves(ws: Column, n: Column) -> Column:
    """Hashes of the first and last n // 2 words, and of (n - 1) // 2 where that is less."""
    small, large = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    ends = lambda m: [F.xxhash64(F.lit(0), m, F.slice(ws, 1, m)), F.xxhash64(F.lit(1), m, F.slice(ws, n - m + 1, m))]
    return F.when(small == large, F.array(*ends(large))).otherwise(F.array(*ends(large), *ends(small)))


def line_decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind) of the lines of ``docs(doc_id, text)`` that go; kind is exact or near, line_no counts from 0.

    Null texts are empty. A row that repeats a doc_id counts as the same document: its lines
    are no copies of their twins. A null doc_id comes before all others. Other columns are
    ignored. No rows give no rows.
    """
    n = F.size("ws")
    each = _lines(docs).select(*PLACE, F.xxhash64("ws").alias("h"), F.xxhash64(F.lit(1), "ws").alias("g"), n.alias("n"), F.when(n < HALF_WORDS, F.array_join("ws", " ")).alias("short"), F.when(n >= HALF_WORDS - 1, _halves(F.col("ws"), n)).alias("keys"))
    lines = table(each, "lines")
    first = lines.groupBy("h", "g").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "short", "keys")))
    firsts = table(first, "line-firsts")
    many = firsts.where("copies > 1").select("h", "g", "first", "copies")
    level = max(lines.count() // HOT, 1000)
    hot, narrow = many.where(F.col("copies") > level).drop("copies"), lines.select(*PLACE, "h", "g")  # at most HOT rows are hot
    if hot.limit(1).count():
        hot, many = F.broadcast(hot), many.where(F.col("copies") <= level)
        met = narrow.join(hot, ["h", "g"]).unionByName(narrow.join(hot, ["h", "g"], "left_anti").join(many.drop("copies"), ["h", "g"]))
    else:
        met = narrow.join(many.drop("copies"), ["h", "g"])
    exact = met.where(~F.struct(*PLACE).eqNullSafe(F.col("first"))).select(*PLACE, F.lit("exact").alias("kind"))
    return exact.unionByName(_near(docs, firsts)).distinct()


def _near(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Of the first occurrences of lines of ``LEAST_WORDS`` words, or one less, and more."""
    keyed = firsts.where(F.col("n") >= HALF_WORDS - 1).select("first.*", "n", F.explode("keys").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("lines")).where("lines > 1").select("key"))
    chosen = cut(keyed.where(F.col("n") >= HALF_WORDS).join(sent_if_small(shared), "key", "left_semi").select(F.col("doc_id").alias("d"), F.col("line_no").alias("l")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line_no") == F.col("l"))
    long = _lines(docs).where(F.size("ws") >= HALF_WORDS).join(sent_if_small(chosen), same, "left_semi").dropDuplicates(list(PLACE))
    short = firsts.where(F.col("n").between(LEAST_WORDS - 1, HALF_WORDS - 1)).select("first.*", F.split("short", " ").alias("ws"))
    words = cut(long.unionByName(short)).withColumnRenamed("ws", "w")

    me = F.struct(*PLACE).alias("me")
    xor = lambda hashes: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))
    placed = let(F.transform("w", lambda w, i: F.xxhash64(w, i)), lambda h: F.struct(h.alias("h"), xor(h).alias("all")))
    swap = words.where(F.size("w") >= LEAST_WORDS).select(*PLACE, F.size("w").alias("n"), placed.alias("p"))
    swap = swap.select(*PLACE, F.explode(F.transform("p.h", lambda h, i: F.xxhash64(F.col("p.all").bitwiseXOR(h), i, F.col("n")))).alias("key"))
    earliest = swap.groupBy("key").agg(F.min(F.struct(*PLACE)).alias("other"), F.count("*").alias("members")).where("members > 1").select("key", "other")
    swapped = swap.join(sent_if_small(cut(earliest)), "key").select(me, "other").where("other < me").distinct()

    part = lambda h, shift: F.shiftrightunsigned(h, shift).bitwiseAND(0x7FFFFFFF)  # noqa: E731  31 bits: no sum over a text's words overflows
    total = lambda h, shift: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + part(x, shift))
    plain = let(F.transform("w", lambda w: F.xxhash64(w)), lambda h: F.struct(h.alias("h"), total(h, 0).alias("a"), total(h, 33).alias("b")))
    sums = words.select(me, F.size("w").alias("n"), plain.alias("p")).select("me", "n", "p.*")
    full = cut(sums.select(F.col("me").alias("whole"), "n", F.xxhash64("a", "b", F.get("h", F.lit(0)), F.get("h", F.col("n") - 1)).alias("key")))
    outer = lambda k: (F.get("h", F.when(k == 0, 1).otherwise(0)), F.get("h", F.col("n") - F.when(k == F.col("n") - 1, 2).otherwise(1)))
    without = F.transform("h", lambda h, k: F.xxhash64(F.col("a") - part(h, 0), F.col("b") - part(h, 33), *outer(k)))
    less = sums.where(F.col("n") >= LEAST_WORDS).select("me", (F.col("n") - 1).alias("rest"), F.explode(F.array_distinct(without)).alias("key")).withColumnRenamed("rest", "n")
    left_out = less.join(sent_if_small(full), ["n", "key"]).select(F.greatest("me", "whole").alias("me"), F.least("me", "whole").alias("other"))

    pairs = cut(swapped.unionByName(left_out).distinct())
    side = lambda name, line: words.select(F.struct(*PLACE).alias(name), F.col("w").alias(line))
    met = pairs.join(side("me", "x"), "me").join(side("other", "y"), "other")
    return met.where(_one_apart(F.col("x"), F.col("y"))).select("me.doc_id", "me.line_no", F.lit("near").alias("kind"))


def _with_gone(docs: DataFrame, *counts: Column) -> tuple[DataFrame, str, Column]:
    """docs with the set of dropped lines of each row and ``counts``, the set's name, and the text without those lines."""
    key, gone = unused("gone_doc", docs), unused("gone_lines", docs)
    kinds = cut(line_decisions(docs)).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(gone), *counts)
    met = docs.join(kinds, docs["doc_id"].cast("long").eqNullSafe(kinds[key]), "left")
    left = let(F.split("text", "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: x[i]), "\n"))
    return met, gone, F.when(F.col(gone).isNull() | F.col("text").isNull(), F.col("text")).otherwise(left)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``, and all rows and columns kept.

    A document may be left with an empty text; a null text stays null. See ``line_decisions``.
    """
    met, _, left = _with_gone(docs)
    return met.withColumn("text", left).select(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (those with a word), n_exact, n_near and the text that is left, of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    met, _, left = _with_gone(docs, F.count_if(F.col("kind") == "exact").alias("n_exact"), F.count_if(F.col("kind") == "near").alias("n_near"))
    count = F.size(F.filter(F.split("text", "\n"), _has_word)).cast("long")
    zero = F.lit(0).cast("long")
    return met.select("doc_id", count.alias("n_lines"), F.coalesce("n_exact", zero).alias("n_exact"), F.coalesce("n_near", zero).alias("n_near"), left.alias("text"))
