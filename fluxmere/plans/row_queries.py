"""Queries over ordered rows, names and dates of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, text, times
from ..operators import files, geometry, runs
from .tables import table

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
WILDCARDS = ("A*.*", "?E*", "*.S??", "")
REQUESTS = ("1..5,,8", "3,,3,,2..4", "7", "5..5,,1", "x")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINE, F.col("l_quantity").cast("long").alias("q"), "l_shipdate", "l_returnflag")


def fimg_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("chunk_no", F.col("l_linenumber") - 1)
    return rows.groupBy("l_orderkey").agg(files.is_sparse("chunk_no").alias("sparse"), (F.max("chunk_no") + 1).cast("long").alias("end"))


def prodos_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    date, time = times.prodos_pack(F.col("ts"))
    rows = table(spark, sf_dir, "events").select("event_id", date.alias("date_word"), time.alias("time_word"))
    return rows.withColumn("back", F.date_format(times.prodos_unpack(F.col("date_word"), F.col("time_word")), "yyyy-MM-dd HH:mm"))


def fat_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    date, time, tenths = times.fat_pack(F.col("ts"))
    rows = table(spark, sf_dir, "events").select("event_id", date.alias("date_word"), time.alias("time_word"), tenths.alias("tenths"))
    return rows.withColumn("back", F.date_format(times.fat_unpack(F.col("date_word"), F.col("time_word"), F.col("tenths")), "yyyy-MM-dd HH:mm:ss"))


def cpm_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, hour, minute = times.cpm_pack(F.col("ts"))
    rows = table(spark, sf_dir, "events").select("event_id", day.alias("day_no"), hour.alias("hour_bcd"), minute.alias("minute_bcd"))
    return rows.withColumn("back", F.date_format(times.cpm_unpack(F.col("day_no"), F.col("hour_bcd"), F.col("minute_bcd")), "yyyy-MM-dd HH:mm"))


def pascal_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", times.pascal_pack(F.col("o_orderdate")).alias("date_word"))
    return orders.withColumn("back", F.date_format(times.pascal_unpack(F.col("date_word")), "yyyy-MM-dd"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


def free_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.free_runs(_events(spark, sf_dir), ["user_id"], ["event_id"], F.col("event_type") == "click")


def first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.first_fit(_events(spark, sf_dir), ["user_id"], ["event_id"], F.col("event_type") == "click", 2)


def bitmap_free_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.bit_count(F.col("o_orderkey").bitwiseAND(F.lit(65535).cast("long"))).cast("long").alias("free"))


def fat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = F.col("o_orderkey") % 50, F.col("o_custkey") % 50
    orders = table(spark, sf_dir, "orders")
    main = orders.select("o_orderkey", first.alias("a"))
    spare = orders.select("o_orderkey", second.alias("b"))
    return main.join(spare, "o_orderkey").select("o_orderkey", files.repaired(F.col("a"), F.col("b"), 40).cast("long").alias("entry"))


def geometry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    of = lambda s, name: (F.count_if(F.col("o_orderstatus") == s).alias(name), F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey"))).alias(f"last_{name}"))
    return orders.groupBy("o_custkey").agg(*of("P", "blank"), *of("O", "unsolved"), *of("F", "solved"))


def histogram_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.percentile_bin(_events(spark, sf_dir), ["event_type"], F.floor("value"), 20)


def motor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = _events(spark, sf_dir).select("user_id", "event_id", F.when(F.col("event_type") != "click", F.length("event_type")).alias("track"))
    placed = runs.running_sum(tracks, ["user_id"], ["event_id"], F.lit(1), -1, "position")
    return runs.motor_stops(placed, ["user_id"], "position", "track")


def block_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*(F.lit(r) for r in REQUESTS)), (F.col("p_partkey") % len(REQUESTS)).cast("int")).alias("request"))
    return parts.select("p_partkey", F.posexplode(geometry.ranges(F.col("request"))).alias("pos", "block")).select("p_partkey", F.col("pos").cast("long").alias("pos"), "block")


def block_to_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(geometry.logical_sectors(F.col("p_partkey"), 3, 3, 32)).alias("pos", "s"))
    return parts.select("p_partkey", F.col("pos").cast("long").alias("pos"), "s.track", "s.sector")


def block_map_525(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(geometry.block_sectors_525(F.col("p_partkey") % 280)).alias("pos", "s"))
    return parts.select("p_partkey", F.col("pos").cast("long").alias("pos"), "s.track", "s.sector", geometry.skewed(F.col("s.sector")).alias("physical"))


def block_map_35(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 900).alias("block"))
    return geometry.block_sector_35(parts, "block").select("p_partkey", F.col("zone").cast("long").alias("zone"), "track", "sector")


def extent_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    return rows.groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct(*LINE[1:])).alias("flag"), F.sum("q").alias("blocks"), F.count("*").alias("extents"))


def renumber_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.renumber(_lines(spark, sf_dir), ["l_orderkey"], LINE[1:], "q", F.col("l_partkey") % 5 == 0, 10, 10)
    return rows.select(*LINE, "new_number")


def deleted_line_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.next_surviving(_lines(spark, sf_dir), ["l_orderkey"], LINE[1:], "l_partkey", F.col("l_returnflag") == "R")
    return rows.select(*LINE, "target")


def semantic_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_partkey").distinct()
    return runs.deltas(rows, ["l_orderkey"], "line", "l_partkey")


def docstring_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.comment_blocks(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", "text").select("conv_id", "first", F.md5("block").alias("digest"))


def fold_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", -1).otherwise(0)
    return runs.running_sum(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], step, 0, "depth").select("conv_id", "turn", "depth")


def token_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    rows = runs.running_sum(lines.where("trim(line) <> ''"), ["doc_id"], ["row_no"], F.octet_length("line") + 5, 2049, "next_address")
    return rows.select("doc_id", F.col("row_no").cast("long").alias("row_no"), "next_address")


def column_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.column_format(F.split("p_name", " ")).alias("line"))


def universal_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.catalog_row(F.substring("p_brand", 1, 4), F.col("p_size").cast("int"), F.col("p_name")).alias("row"))


def name_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", text.name_valid(name, "fat").alias("fat"), text.name_valid(name, "prodos").alias("prodos"))


def wildcard_83(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.substring(F.get(words, 0), 1, 8).alias("base"), F.substring(F.coalesce(F.get(words, 1), F.lit("")), 1, 3).alias("kind"))
    return parts.select("p_partkey", *(text.wildcard_match(F.col("base"), F.col("kind"), w).alias(f"m{k}") for k, w in enumerate(WILDCARDS)))


def glob_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(text.glob(F.col("p_name"), "*e? *[a-m]", separator=False)).select("p_partkey", F.upper("p_name").alias("name"))


def glob_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(text.glob(F.col("url"), "https://*/en/*", case_sensitive=True)).select("page_id", "url")


def path_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^(.*)/[^/]*$", 1).alias("parent"), F.regexp_extract("url", "[^/]*$", 0).alias("name"))


def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.explode(files.json_leaves(F.col("props"))).alias("x")).select("event_id", "x.path", "x.leaf")


def json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of events as nested objects, with their key paths."""
    events = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"event":{"id":'), F.col("event_id").cast("string"), F.lit(',"props":'), "props", F.lit('},"type":"'), "event_type", F.lit('","tags":[1,{"a":2}],"none":{}}'))
    return files.leaf_rows(events.select("event_id", text.alias("t")), ["event_id"], F.col("t")).select("event_id", F.array_join("path", "/").alias("path"), "leaf")


def left_password(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return docs.join(labels, "doc_id", "left")


def detached_password(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: F.count_if(F.col("event_type") == t)
    return _events(spark, sf_dir).groupBy("user_id").agg(one("error").alias("errors"), one("click").alias("warnings"), one("view").alias("infos"))


def linker_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", binary.let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), F.size(F.filter(x, lambda y: y.rlike("(?i)^ *[a-z]+ +[a-z]+"))).cast("long").alias("n_linked"))).alias("c")).select("doc_id", "c.*")
    return docs.withColumn("kind", F.when(F.col("n_linked") * 10 >= F.col("n_lines") * 9, "linker").otherwise("source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        fimg_sparse, prodos_time, fat_time, cpm_time, pascal_date, free_runs, first_fit, bitmap_free_count, fat_repair, geometry_summary, histogram_percentile, motor_window, block_range, block_to_sectors, block_map_525, block_map_35,
        extent_group, renumber_map, deleted_line_remap, semantic_deltas, docstring_islands, fold_depth, token_addresses, column_format, universal_catalog, name_validity, wildcard_83, glob_flat, glob_path, path_split, json_leaves, json_tree,
        left_password, detached_password, severity_counts, linker_fraction,
    )
}

_ISLANDS = """
WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position FROM events),
i AS (SELECT user_id, position, position - row_number() OVER (PARTITION BY user_id ORDER BY position) AS island FROM p WHERE event_type = 'click'),
g AS (SELECT user_id, island, count(*) AS n, min(position) AS first FROM i GROUP BY user_id, island)"""
_LINE = ", ".join(LINE)
_ORDER = ", ".join(LINE[1:])


def _list(values: list[int]) -> str:
    return f"[{', '.join(map(str, values))}]"


def _wild(k: int, pattern: str) -> str:
    return f"true AS m{k}" if not pattern else f"rpad(upper(base), 8, ' ') || rpad(upper(kind), 3, ' ') LIKE '{text.wildcard_pattern(pattern)}' ESCAPE '!' AS m{k}"


ORACLE = {
    "fimg_sparse": 'SELECT l_orderkey, min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber) AS sparse, CAST(max(l_linenumber) AS BIGINT) AS "end" FROM lineitem GROUP BY l_orderkey',
    "prodos_time": "SELECT event_id, CAST(day(ts) + month(ts) * 32 + year(ts) % 100 * 512 AS BIGINT) AS date_word, CAST(minute(ts) + hour(ts) * 256 AS BIGINT) AS time_word, strftime(ts, '%Y-%m-%d %H:%M') AS back FROM events",
    "fat_time": "SELECT event_id, CAST(day(ts) + month(ts) * 32 + (year(ts) - 1980) * 512 AS BIGINT) AS date_word, CAST(second(ts) // 2 + minute(ts) * 32 + hour(ts) * 2048 AS BIGINT) AS time_word, CAST(millisecond(ts) % 1000 // 100 + second(ts) % 2 * 10 AS BIGINT) AS tenths, strftime(ts, '%Y-%m-%d %H:%M:%S') AS back FROM events",
    "cpm_time": "SELECT event_id, CAST(CAST(ts AS DATE) - DATE '1978-01-01' + 1 AS BIGINT) AS day_no, CAST(hour(ts) // 10 * 16 + hour(ts) % 10 AS BIGINT) AS hour_bcd, CAST(minute(ts) // 10 * 16 + minute(ts) % 10 AS BIGINT) AS minute_bcd, strftime(ts, '%Y-%m-%d %H:%M') AS back FROM events",
    "pascal_date": "SELECT o_orderkey, CAST(month(o_orderdate) + day(o_orderdate) * 16 + year(o_orderdate) % 100 * 512 AS BIGINT) AS date_word, strftime(try_cast(concat('19', strftime(o_orderdate, '%y-%m-%d')) AS DATE), '%Y-%m-%d') AS back FROM orders",
    "free_runs": _ISLANDS + " SELECT u.user_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS free, CAST(coalesce(max(n), 0) AS BIGINT) AS largest FROM (SELECT DISTINCT user_id FROM events) AS u LEFT JOIN g USING (user_id) GROUP BY u.user_id",
    "first_fit": _ISLANDS + " SELECT user_id, CAST(min(first) AS BIGINT) AS start FROM g WHERE n >= 2 GROUP BY user_id",
    "bitmap_free_count": "SELECT o_orderkey, CAST(bit_count(o_orderkey & 65535) AS BIGINT) AS free FROM orders",
    "fat_repair": "SELECT o_orderkey, CAST(CASE WHEN NOT (a BETWEEN 2 AND 39) AND b BETWEEN 2 AND 39 THEN b ELSE a END AS BIGINT) AS entry FROM (SELECT o_orderkey, o_orderkey % 50 AS a, o_custkey % 50 AS b FROM orders)",
    "geometry_summary": "SELECT o_custkey, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS {n}, max(CASE WHEN o_orderstatus = '{s}' THEN o_orderkey END) AS last_{n}" for s, n in (("P", "blank"), ("O", "unsolved"), ("F", "solved"))) + " FROM orders GROUP BY o_custkey",
    "histogram_percentile": "SELECT event_type, min(bin) AS bin FROM (SELECT event_type, bin, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM (SELECT event_type, CAST(floor(value) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2)) WHERE upto * 100 > total * 20 GROUP BY event_type",
    "motor_window": """
WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS m, CASE WHEN event_type <> 'click' THEN length(event_type) END AS h FROM events),
q AS (SELECT user_id, m, h, lag(h, 1) OVER w AS qp, lag(h, 2) OVER w AS w, lag(h, 3) OVER w AS qm FROM t WINDOW w AS (PARTITION BY user_id ORDER BY m))
SELECT user_id, CAST(unnest(CASE WHEN w IS NOT NULL AND h IS NOT NULL THEN CASE WHEN w = h THEN [m - 2] ELSE [m - 2, m] END WHEN w IS NOT NULL THEN [m - 2]
  WHEN h IS NOT NULL THEN [m] WHEN qp IS NOT NULL THEN [m - 1] WHEN qm IS NOT NULL THEN [m - 3] ELSE [m - 2] END) AS BIGINT) AS stop FROM q WHERE m % 4 = 2""",
    "block_range": "SELECT p_partkey, CAST(pos AS BIGINT) AS pos, CAST(block AS BIGINT) AS block FROM part JOIN (VALUES (0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 8), (1, 0, 3), (1, 1, 3), (1, 2, 2), (1, 3, 3), (2, 0, 7), (3, 0, 1)) AS v(r, pos, block) ON p_partkey % 5 = r",
    "block_to_sectors": "SELECT p_partkey, i AS pos, (p_partkey * 8 + i) // 32 + 3 AS track, (p_partkey * 8 + i) % 32 + 1 AS sector FROM part, range(8) AS r(i)",
    "block_map_525": f"SELECT p_partkey, pos, track, CAST(sector AS BIGINT) AS sector, CAST(({_list(geometry.DOS_SKEW)})[sector + 1] AS BIGINT) AS physical FROM (SELECT p_partkey, pos, p_partkey % 280 // 8 AS track, CASE WHEN pos = 0 THEN ({_list(geometry.FIRST_SECTORS)})[p_partkey % 280 % 8 + 1] ELSE ({_list(geometry.SECOND_SECTORS)})[p_partkey % 280 % 8 + 1] END AS sector FROM part, range(2) AS r(pos))",
    "block_map_35": "SELECT p_partkey, z AS zone, CAST(16 * z + (b - lo) // n AS BIGINT) AS track, CAST((b - lo) % n AS BIGINT) AS sector FROM (SELECT p_partkey, p_partkey % 900 AS b FROM part) JOIN (VALUES (0, 0, 192, 12), (1, 192, 368, 11), (2, 368, 528, 10), (3, 528, 672, 9), (4, 672, 800, 8)) AS v(z, lo, hi, n) ON b >= lo AND b < hi",
    "extent_group": f"SELECT l_orderkey, arg_min(l_returnflag, ROW({_ORDER})) AS flag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS blocks, count(*) AS extents FROM lineitem GROUP BY l_orderkey",
    "renumber_map": f"""
WITH r AS (SELECT {_LINE}, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS n FROM lineitem),
p AS (SELECT *, sum(CASE WHEN n > 1 AND l_partkey % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n) AS seg FROM r)
SELECT {_LINE}, CAST(CASE WHEN seg = 0 THEN 10 ELSE first_value(q) OVER (PARTITION BY l_orderkey, seg ORDER BY n) END + 10 * (row_number() OVER (PARTITION BY l_orderkey, seg ORDER BY n) - 1) AS BIGINT) AS new_number FROM p""",
    "deleted_line_remap": f"SELECT {_LINE}, target FROM (SELECT *, first_value(CASE WHEN l_returnflag <> 'R' THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS target FROM lineitem) WHERE l_returnflag = 'R'",
    "semantic_deltas": "SELECT l_orderkey, line, l_partkey, line - coalesce(lag(line) OVER w, 0) AS delta_line, CASE WHEN line = coalesce(lag(line) OVER w, 0) THEN l_partkey - coalesce(lag(l_partkey) OVER w, 0) ELSE l_partkey END AS delta_column FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY line, l_partkey)",
    "docstring_islands": """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations), i AS (SELECT *, position - row_number() OVER (PARTITION BY conv_id ORDER BY position) AS island FROM p WHERE role = 'user')
SELECT conv_id, min(position) AS first, md5(string_agg(text, chr(10) ORDER BY position)) AS digest FROM i GROUP BY conv_id, island""",
    "fold_depth": "SELECT conv_id, turn, CAST(sum(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS depth FROM conversations",
    "token_addresses": "SELECT doc_id, row_no, CAST(2049 + sum(octet_length(encode(line)) + 5) OVER (PARTITION BY doc_id ORDER BY row_no) AS BIGINT) AS next_address FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS row_no FROM documents) WHERE trim(line) <> ''",
    "universal_catalog": "SELECT p_partkey, printf('%-4s %5d  %s', substr(p_brand, 1, 4), p_size, p_name) AS row FROM part",
    "name_validity": f"SELECT p_partkey, regexp_matches(upper(n), '{text.NAME_PATTERNS['fat'].replace(chr(39), chr(39) * 2)}') AS fat, regexp_matches(upper(n), '{text.NAME_PATTERNS['prodos']}') AS prodos FROM (SELECT p_partkey, replace(p_name, ' ', '.') AS n FROM part)",
    "wildcard_83": f"SELECT p_partkey, {', '.join(_wild(k, w) for k, w in enumerate(WILDCARDS))} FROM (SELECT p_partkey, substr(string_split(p_name, ' ')[1], 1, 8) AS base, substr(coalesce(string_split(p_name, ' ')[2], ''), 1, 3) AS kind FROM part)",
    "glob_flat": "SELECT p_partkey, upper(p_name) AS name FROM part WHERE regexp_matches(upper(p_name), '^.*E. .*[A-M]$')",
    "glob_path": "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://[^/]*/en/[^/]*$')",
    "path_split": "SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(url, '[^/]*$', 0) AS name FROM pages",
    "json_leaves": "SELECT event_id, k AS path, json_extract_string(props, concat('$.\"', k, '\"')) AS leaf FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    "json_tree": """
SELECT event_id, concat('event/props/', k) AS path, json_extract_string(props, concat('$."', k, '"')) AS leaf FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)
UNION ALL SELECT event_id, 'event/id', CAST(event_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'type', event_type FROM events UNION ALL SELECT event_id, 'tags', '[1,{"a":2}]' FROM events""",
    "left_password": "SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    "detached_password": "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
    "severity_counts": "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS warnings, count(*) FILTER (WHERE event_type = 'view') AS infos FROM events GROUP BY user_id",
    "linker_fraction": "SELECT doc_id, n_lines, n_linked, CASE WHEN n_linked * 10 >= n_lines * 9 THEN 'linker' ELSE 'source' END AS kind FROM (SELECT doc_id, len(x) AS n_lines, len(list_filter(x, lambda y: regexp_matches(y, '(?i)^ *[a-z]+ +[a-z]+'))) AS n_linked FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))",
}
