"""Links between documents and symbols: closures, best matches, look-ups as of a place."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, sent_if_small

#: Length of a chain that runs into a cycle.
ENDLESS = -1
#: Nodes of united sets that may be sent to every task, and pairs that a task makes.
SENT_NODES = 2_000_000
PAIRS = 2_000_000
#: Sorted lines of plain words with the same first two characters. Possessive groups keep the matcher from recursing.
_PLAIN = r"(?m)^([a-z0-9]{2})[a-z0-9]*+(?:\n\1[a-z0-9]*+)++$"
#: A line with a sigil; a word with one: two characters of its stem, the others, the sigil; sorted lines "short word" with the same short.
_SIGIL, _SIGNED, _RUN = r"(?m)^[a-z0-9]*+[$%][^\n]*+\n?", r"(?m)^([a-z0-9]{2})([a-z0-9]*+)([$%][^\n]*+)$", r"(?m)^([^ \n]++) [^\n]++(?:\n\1 [^\n]++)++$"


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """(node, other) of ``edges(src, dst)``: all that reach a node in at most ``depth`` steps, itself excluded.

    The breadth-first search finds what is ahead of each node that is linked to, a join a step
    over the pairs that the last one added, and only over links between such nodes; it stops
    when there are none. Nodes with the same ones ahead are one class. A source reaches what is
    ahead of its links' classes: these sets are united once for all sources that have the same
    classes, and the pairs are made last and never shuffled.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    linked = cut(edges.select("dst").distinct())
    steps = cut(edges.join(linked.withColumnRenamed("dst", "src"), "src", "left_semi").select(F.col("src").alias("at"), F.col("dst").alias("then")))
    ahead = new = linked.select("dst", F.col("dst").alias("node"))
    whole = False
    for _ in range(depth - 1):
        further = new.join(steps, new.node == steps.at).select("dst", F.col("then").alias("node")).distinct()
        new = cut(further.join(ahead, ["dst", "node"], "left_anti"))
        if whole := new.isEmpty():
            break
        ahead = ahead.unionByName(new)
    sets = ahead.groupBy("dst").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    classes = cut(sets.groupBy("nodes").agg(F.min("dst").alias("class"), F.collect_list("dst").alias("all")))
    # a source's largest class, and those of its links that this one does not hold
    ends = steps.select(F.col("at").alias("dst")).distinct().withColumn("goes_on", F.lit(True))
    of = classes.select("class", F.size("nodes").alias("n"), F.explode("all").alias("dst")).join(ends, "dst", "left")
    links = edges.join(of, "dst")
    most = links.groupBy("src").agg(F.max(F.struct("n", "class"))["class"].alias("most"))
    inside = classes.select(F.col("class").alias("most"), F.explode("nodes").alias("dst")).withColumn("inside", F.lit(True))
    held = F.col("inside").isNotNull() & (F.lit(whole) | F.col("goes_on").isNull())
    rest = links.join(most, "src").where("class <> most").join(inside, ["most", "dst"], "left").where(~held).select("src", "class")
    sources = cut(most.select("src", F.col("most").alias("class")).unionByName(rest).groupBy("src").agg(F.sort_array(F.collect_set("class")).alias("classes")))
    parts = sources.groupBy("classes").agg(F.count("*").alias("times")).select("classes", "times", F.explode("classes").alias("class")).join(classes.select("class", "nodes"), "class")
    united = cut(parts.groupBy("classes", "times").agg(F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("nodes")))
    size = united.agg(F.coalesce(F.sum(F.size("nodes")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size("nodes") * F.col("times")), F.lit(0)).alias("pairs")).first()
    united = united.drop("times")
    met = sources.repartition(1 + size["pairs"] // PAIRS).join(F.broadcast(united) if size["n"] <= SENT_NODES else united, "classes")
    return met.select(F.explode("nodes").alias("node"), F.col("src").alias("other")).where("node <> other")


def chain_lengths(links: DataFrame) -> DataFrame:
    """(start, n) of every cluster of ``links(cluster, next)``: clusters in the chain from it to its end, ``ENDLESS`` if it runs into a cycle.

    An entry under 2, a null one and one that names no cluster of ``links`` end a chain.
    Pointer doubling: a round follows every open chain twice as far as the last. A chain with
    an end has no more clusters than there are, so what is open after so many links is endless.
    """
    known = links.select(F.col("cluster").alias("next"), F.lit(True).alias("_known"))
    goes_on = (F.col("next") >= 2) & F.col("_known")
    ends = links.join(known, "next", "left").select("cluster", F.when(goes_on, F.col("next")).alias("at"), F.lit(1).cast("long").alias("n"))
    chains = cut(ends)
    clusters, reach = chains.count(), 1
    while reach < clusters and not chains.where("at is not null").isEmpty():
        further = chains.select(F.col("cluster").alias("at"), F.col("at").alias("then"), F.col("n").alias("more"))
        chains = cut(chains.join(further, "at", "left").select("cluster", F.col("then").alias("at"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        reach *= 2
    return chains.select(F.col("cluster").alias("start"), F.when(F.col("at").isNull(), F.col("n")).otherwise(F.lit(ENDLESS).cast("long")).alias("n"))


def best_suffix(targets: DataFrame, documents: DataFrame, path: str = "path", uri: str = "uri") -> DataFrame:
    """(path, uri, quality) for paths that one document fits best: by equal trailing segments, case ignored, then the shortest uri.

    Paths for which two documents tie are left out. Documents are aggregated by each of their
    endings before a path meets them, so a row an ending is all that a common name makes.
    """

    def endings(of: DataFrame, name: str) -> DataFrame:
        parts = F.filter(F.split(F.lower(name), "/"), lambda x: x != "")
        each = of.select(name, parts.alias("s")).where("size(s) > 0")
        return each.select(name, F.explode(F.sequence(F.lit(1), F.size("s"))).alias("quality"), "s").select(name, F.col("quality").cast("long").alias("quality"), F.array_join(F.slice("s", -F.col("quality"), F.col("quality")), "/").alias("ending"))

    theirs = endings(documents.select(F.col(uri).alias("uri")).distinct(), "uri").withColumn("n", F.length("uri"))
    alike = theirs.groupBy("ending", "n").agg(F.count("*").alias("ties"), F.min("uri").alias("uri"))
    best = alike.groupBy("ending").agg(F.min(F.struct("n", "ties", "uri")).alias("doc"))
    met = endings(targets.select(F.col(path).alias("path")).distinct(), "path").join(best, "ending")
    top = met.groupBy("path").agg(F.max_by("doc", "quality").alias("doc"), F.max("quality").alias("quality"))
    return top.where("doc.ties = 1").select("path", "doc.uri", "quality")


def as_of(left: DataFrame, right: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` of its key that stands strictly before its place; null if none.

    One union and one window instead of a range join: rows of a key are ordered once.
    """
    ours = left.withColumns({"_mine": F.lit(True), value: F.lit(None).cast(right.schema[value].dataType)})
    theirs = right.select(key, place, value).withColumn("_mine", F.lit(False))
    over = Window.partitionBy(key).orderBy(place).rangeBetween(Window.unboundedPreceding, -1) if dict(left.dtypes)[place] in ("int", "bigint") else None
    rows = ours.unionByName(theirs, allowMissingColumns=True)
    if over is None:  # no arithmetic on the place: own rows come first among equals
        over = Window.partitionBy(key).orderBy(place, F.col("_mine").desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(~F.col("_mine"), F.col(value)), True).over(over)
    return rows.withColumn(value, known).where("_mine").drop("_mine")


def collisions(df: DataFrame, key: list[str], name: Column) -> DataFrame:
    """key, short, names: long names that share their first two characters and their sigil."""
    stem = F.regexp_extract(name, "^[A-Za-z0-9]*", 0)
    short = F.concat(F.substring(name, 1, 2), F.substr(name, F.length(stem) + 1))
    named = df.select(*key, name.alias("name"), short.alias("short"), F.length(stem).alias("n")).where("n >= 2")
    return named.groupBy(*key, "short").agg(F.array_sort(F.collect_set("name")).alias("names")).where("size(names) > 1")


def text_collisions(df: DataFrame, key: list[str], text: Column) -> DataFrame:
    """key, short, n, names: the distinct words of all texts of a key that ``collisions`` would group, joined by blanks.

    A word has letters, digits, ``$`` and ``%``; case is ignored. Words that collide stand side by
    side among a text's sorted words without sigils, so one scan finds each group whole and a key
    with one text needs no shuffle. Words with a sigil, few as a rule, are sorted once more behind
    their short names. Texts of keys that occur again are grouped by word.
    """
    low = F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))  # the one letter whose lower case has two characters
    texts = df.select(*key, F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9$%]{2,}+"), F.lit(0))).alias("words"))
    again = cut(df.groupBy(*key).agg(F.count("*").alias("times")).where("times > 1").select(*(F.col(k).alias(f"_{k}") for k in key)))
    if again.isEmpty():
        return _side_by_side(texts, key)
    again = sent_if_small(again)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key))
    words = texts.join(again, same, "left_semi").select(*key, F.explode("words").alias("word"))
    found = collisions(words, key, F.col("word")).select(*key, "short", F.size("names").cast("long").alias("n"), F.array_join("names", " ").alias("names"))
    return _side_by_side(texts.join(again, same, "left_anti"), key).unionByName(found)


def _side_by_side(texts: DataFrame, key: list[str]) -> DataFrame:
    """The groups within each row of ``texts(*key, words)``."""
    lines = texts.select(*key, F.array_join(F.sort_array("words"), "\n").alias("lines"))
    plain = F.regexp_extract_all(F.regexp_replace("lines", _SIGIL, ""), F.lit(_PLAIN), F.lit(0))
    signed = F.regexp_replace(F.array_join(F.regexp_extract_all("lines", F.lit(_SIGNED), F.lit(0)), "\n"), _SIGNED, "$1$3 $1$2$3")
    signed = F.regexp_extract_all(F.array_join(F.sort_array(F.split(signed, "\n")), "\n"), F.lit(_RUN), F.lit(0))
    runs = lines.select(*key, F.explode(F.concat(plain, signed)).alias("run"))
    is_signed = F.contains("run", F.lit(" "))
    runs = runs.withColumn("short", F.when(is_signed, F.substring_index("run", " ", 1)).otherwise(F.substring("run", 1, 2)))
    bare = F.when(is_signed, F.substr(F.replace(F.concat(F.lit("\n"), "run"), F.concat(F.lit("\n"), "short", F.lit(" ")), F.lit("\n")), F.lit(2))).otherwise(F.col("run"))
    runs = runs.withColumn("names", F.replace(bare, F.lit("\n"), F.lit(" ")))
    return runs.select(*key, "short", (F.length("names") - F.length(F.replace("names", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n"), "names")
