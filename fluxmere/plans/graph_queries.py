"""Queries over links: trees, chains, closures, look-ups and anti-joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary
from ..operators import graphs
from .tables import table

#: The analyzer's depths 0 to 8.
DEPTH = 9


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order refers to another customer's number."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 31 + 7) % 1700).alias("dst"))


def backlinks_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.closure(_edges(spark, sf_dir), DEPTH)


def masters_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that include others and that none includes; here every customer with an order includes one number."""
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 31 + 7) % 1700).alias("dst"))
    return edges.select("src").distinct().join(edges.select(F.col("dst").alias("src")), "src", "left_anti")


def undefined_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dst"))
    return _edges(spark, sf_dir).join(known, "dst", "left_anti").select("src", "dst")


def fat_chain_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters in each chain, followed to its end; -1 for a chain that runs into a cycle."""
    links = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cluster"), ((F.col("p_partkey") * 17 + F.col("p_size")) % 199).alias("next"))
    return graphs.chain_lengths(links)


def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, depth, children) of a region, nation, customer tree."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    join = lambda *c: F.concat_ws("/", *c)
    counts = customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = customer.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select(join("r_name", "n_name", "c_name").alias("path"), F.lit(3).cast("long").alias("depth"), F.lit(0).cast("long").alias("children"))
    inner = nations.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(join("r_name", "n_name").alias("path"), F.lit(2).cast("long").alias("depth"), F.coalesce("n", F.lit(0)).alias("children"))
    top = nations.groupBy("r_name").agg(F.count("*").alias("children")).select(F.col("r_name").alias("path"), F.lit(1).cast("long").alias("depth"), "children")
    return leaves.unionByName(inner).unionByName(top)


def asof_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    uses, values = events.where("event_type = 'purchase'").drop("event_type"), events.where("event_type = 'click'").select("user_id", "event_id", F.col("event_id").alias("value"))
    return graphs.as_of(uses, values, "user_id", "event_id", "value").select("user_id", "event_id", "value")


def suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("url")
    paths = urls.select(F.regexp_extract("url", "([^/]+/[^/]+)$", 1).alias("path")).where("path <> ''")
    return graphs.best_suffix(paths, urls.withColumnRenamed("url", "uri"))


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graphs.text_collisions(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], F.col("text"))
    return found.select("doc_id", "short", "n", F.md5("names").alias("digest"))


def collision_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of a conversation's turns: sets united over linked documents."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.split("text", r"[ \t\n\r]+")).alias("word")).where("word <> ''").distinct()
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list(F.hex(binary.utf8(F.col("word"))))), " ")).alias("digest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (backlinks_closure, masters_antijoin, undefined_refs, fat_chain_length, tree_rollup, asof_symbol, suffix_match, collisions, collision_union)}

_EDGES = "WITH e AS (SELECT o_custkey AS src, (o_orderkey * 31 + 7) % 1700 AS dst FROM orders)"

ORACLE = {
    "masters_antijoin": "SELECT DISTINCT o_custkey AS src FROM orders WHERE o_custkey NOT IN (SELECT (o_custkey * 31 + 7) % 1700 FROM orders)",
    "undefined_refs": _EDGES + " SELECT src, dst FROM e WHERE dst NOT IN (SELECT c_custkey FROM customer)",
    "fat_chain_length": """
WITH RECURSIVE t AS (SELECT p_partkey AS cluster, (p_partkey * 17 + p_size) % 199 AS nxt FROM part),
c AS (SELECT cluster AS start, nxt AS at, CAST(1 AS BIGINT) AS n FROM t UNION ALL SELECT c.start, t.nxt, c.n + 1 FROM c JOIN t ON t.cluster = c.at WHERE c.at >= 2 AND c.n <= 200)
SELECT start, CASE WHEN max(n) > 200 THEN -1 ELSE max(n) END AS n FROM c GROUP BY start""",
    "tree_rollup": """
SELECT concat_ws('/', r_name, n_name, c_name) AS path, CAST(3 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS children FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT concat_ws('/', r_name, n_name), 2, count(c_custkey) FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name
UNION ALL SELECT r_name, 1, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "asof_symbol": "SELECT u.user_id, u.event_id, v.event_id AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') AS u ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') AS v ON u.user_id = v.user_id AND u.event_id > v.event_id",
    "collisions": """
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9$%]+'))) AS word FROM documents),
s AS (SELECT doc_id, word, regexp_extract(word, '^[a-z0-9]*', 0) AS stem FROM w), k AS (SELECT DISTINCT doc_id, concat(substr(word, 1, 2), substr(word, length(stem) + 1)) AS short, word FROM s WHERE length(stem) >= 2)
SELECT doc_id, short, count(*) AS n, md5(string_agg(word, ' ' ORDER BY word)) AS digest FROM k GROUP BY doc_id, short HAVING count(*) > 1""",
    "collision_union": "SELECT conv_id, count(*) AS n, md5(string_agg(h, ' ' ORDER BY h)) AS digest FROM (SELECT DISTINCT conv_id, hex(encode(word)) AS h FROM (SELECT conv_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS word FROM conversations) WHERE word <> '') GROUP BY conv_id",
    "suffix_match": """
WITH p AS (SELECT DISTINCT regexp_extract(url, '([^/]+/[^/]+)$', 1) AS path FROM pages WHERE regexp_matches(url, '[^/]+/[^/]+$')), u AS (SELECT DISTINCT url AS uri FROM pages),
a AS (SELECT path, list_reverse(list_filter(string_split(lower(path), '/'), lambda x: x <> '')) AS a FROM p), b AS (SELECT uri, list_reverse(list_filter(string_split(lower(uri), '/'), lambda x: x <> '')) AS b FROM u),
m AS (SELECT path, uri, CAST(CASE WHEN a[2] IS NOT DISTINCT FROM b[2] THEN 2 ELSE 1 END AS BIGINT) AS quality, length(uri) AS n FROM a JOIN b ON a[1] = b[1]),
r AS (SELECT *, rank() OVER (PARTITION BY path ORDER BY quality DESC, n) AS k FROM m)
SELECT path, min(uri) AS uri, max(quality) AS quality FROM r WHERE k = 1 GROUP BY path HAVING count(*) = 1""",
}
