"""Queries over programs and small codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import basic, binary, codes
from ..storage import ship
from .tables import table


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program for each order, a line for each of its items. Python workers read it, so they get this package."""
    ship(spark)
    number = (F.col("l_linenumber") * 10).cast("string")
    line = F.concat(number, F.lit(' print "ITEM '), F.col("l_partkey").cast("string"), F.lit('": goto '), number, F.lit("\n"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), line.alias("line")).alias("item"))
    return items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("item")), lambda x: x["line"]), "").alias("program"))


def basic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _programs(spark, sf_dir).select("l_orderkey", basic.tokens(F.col("program")).alias("t"))
    return coded.select("l_orderkey", F.octet_length("t").cast("long").alias("n_bytes"), F.md5(F.hex("t")).alias("digest"))


def basic_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenised and listed again."""
    coded = _programs(spark, sf_dir).select("l_orderkey", basic.tokens(F.col("program")).alias("t"))
    return coded.select("l_orderkey", basic.listing(F.col("t")).alias("listing"))


def radix_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 4 == 0, F.concat(F.lit("$"), F.lower(F.hex(key)))).when(key % 4 == 1, F.concat(F.lit("%"), F.bin(key), F.lit("_1"))).when(key % 4 == 2, F.concat(F.lit(" "), key.cast("string"))).otherwise(F.concat(F.lit("x"), key.cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", codes.radix_literal(text).alias("value"))


def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose dotted number is a version of at least 2.10.0."""
    key = F.col("p_partkey")
    text = F.concat_ws(".", (key % 5).cast("string"), (key % 13).cast("string"), F.when(key % 7 == 0, "rc1").otherwise((key % 17).cast("string")))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), codes.version(text).alias("v"))
    return rows.where(F.col("v") >= F.struct(F.lit(2), F.lit(10), F.lit(0))).select("p_partkey", "text")


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    address, byte = F.col("o_orderkey") % 65536, F.col("o_custkey") % 256
    rows = table(spark, sf_dir, "orders").select("o_orderkey", address.alias("address"), codes.branch_target(address, byte).alias("target"))
    return rows.select("o_orderkey", "target", codes.branch_offset(F.col("address"), F.col("target")).cast("long").alias("back"))


def highest_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", codes.highest_bit(F.col("o_orderkey") - 1).alias("bit"))


def track_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", codes.place_of(F.col("p_partkey"), 2).alias("p"))
    return rows.select("p_partkey", "p.*", codes.track_of(F.col("p.cylinder"), F.col("p.head"), 2).alias("track"))


def escape_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts escaped as bytes, and the bytes that this means."""
    from ..functions import text

    docs = table(spark, sf_dir, "documents").select("doc_id", text.escaped_ascii(binary.utf8(F.col("text"))).alias("escaped"))
    return docs.select("doc_id", F.md5(codes.unescaped(F.col("escaped"))).alias("digest"))


def password_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", codes.password_code(F.concat(F.lit("pw"), F.col("c_custkey").cast("string"))).alias("p"))
    return rows.select("c_custkey", "p.*")


def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn, with what the next turn of the conversation says over it where that says something."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role")
    over = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.when(F.col("role") == "user", F.col("text")).alias("over")).groupBy("conv_id", "turn").agg(F.max("over").alias("over"))
    return turns.join(over, ["conv_id", "turn"], "left").select("conv_id", "turn", F.md5(codes.mostly_copy(F.col("text"), F.col("over"))).alias("digest"))


def cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as bytes up to the first line feed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.hex(binary.utf8(F.col("text"))).alias("h"))
    return docs.select("doc_id", F.md5(codes.cut_at(F.col("h"), "0A")).alias("digest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (basic_tokens, basic_listing, radix_literals, version_order, branches, highest_bits, track_places, escape_bytes, password_codes, merged_rows, cut_text)
}

_HEX = "upper(hex(encode({})))"
_WORD = "concat(lpad(to_hex({0} & 255), 2, '0'), lpad(to_hex(({0} >> 8) & 255), 2, '0'))"

ORACLE = {
    "basic_tokens": f"""
WITH l AS (SELECT l_orderkey, l_linenumber AS k, l_linenumber * 10 AS n, concat('BA22', {_HEX.format("concat('ITEM ', l_partkey)")}, '223AAB', {_HEX.format("CAST(l_linenumber * 10 AS VARCHAR)")}) AS body FROM lineitem),
a AS (SELECT *, CAST(2049 + sum(length(body) // 2 + 5) OVER (PARTITION BY l_orderkey ORDER BY k, body ROWS UNBOUNDED PRECEDING) AS BIGINT) AS next FROM l),
p AS (SELECT l_orderkey, concat(string_agg(concat({_WORD.format("next")}, {_WORD.format("n")}, body, '00'), '' ORDER BY k, body), '0000') AS h FROM a GROUP BY l_orderkey)
SELECT l_orderkey, CAST(length(h) // 2 AS BIGINT) AS n_bytes, md5(h) AS digest FROM p""",
    "basic_listing": """SELECT l_orderkey, string_agg(concat(l_linenumber * 10, '  PRINT "ITEM ', l_partkey, '": GOTO ', l_linenumber * 10, chr(10)), '' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS listing FROM lineitem GROUP BY l_orderkey""",
    "radix_literals": "SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN 2 * o_orderkey + 1 WHEN 2 THEN o_orderkey END AS BIGINT) AS value FROM orders",
    "version_order": "SELECT p_partkey, concat(p_partkey % 5, '.', p_partkey % 13, '.', p_partkey % 17) AS text FROM part WHERE p_partkey % 7 <> 0 AND (p_partkey % 5 > 2 OR p_partkey % 5 = 2 AND p_partkey % 13 >= 10)",
    "branches": """
WITH t AS (SELECT o_orderkey, o_custkey % 256 AS b, o_orderkey % 65536 + 2 + CASE WHEN o_custkey % 256 > 127 THEN o_custkey % 256 - 256 ELSE o_custkey % 256 END AS target FROM orders)
SELECT o_orderkey, CAST(CASE WHEN target BETWEEN 0 AND 65535 THEN target END AS BIGINT) AS target, CAST(CASE WHEN target BETWEEN 0 AND 65535 THEN b END AS BIGINT) AS back FROM t""",
    "highest_bits": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey = 1 THEN 0 ELSE length(to_binary(o_orderkey - 1)) END AS BIGINT) AS bit FROM orders",
    "track_places": "SELECT p_partkey, CAST(p_partkey // 2 AS BIGINT) AS cylinder, CAST(p_partkey % 2 AS BIGINT) AS head, CAST(p_partkey AS BIGINT) AS track FROM part",
    "escape_bytes": "SELECT doc_id, md5(hex(encode(text))) AS digest FROM documents",
    "password_codes": """
WITH p AS (SELECT c_custkey, list_transform(string_split(rpad(substr(upper(concat('pw', c_custkey)), 1, 8), 8, ' '), ''), lambda x: ascii(x)) AS v FROM customer), d AS (SELECT c_custkey, v, CAST(list_sum(v) AS INTEGER) % 256 AS decoder FROM p)
SELECT c_custkey, CAST(decoder AS BIGINT) AS decoder, array_to_string(list_transform(list_reverse(v), lambda x: lpad(to_hex(xor(x, decoder)), 2, '0')), '') AS hex FROM d""",
    "merged_rows": """
WITH o AS (SELECT conv_id, turn - 1 AS turn, max(CASE WHEN role = 'user' THEN text END) AS over FROM conversations GROUP BY conv_id, turn - 1)
SELECT c.conv_id, c.turn, md5(coalesce(nullif(o.over, ''), c.text)) AS digest FROM conversations AS c LEFT JOIN o ON c.conv_id = o.conv_id AND c.turn = o.turn""",
    "cut_text": "SELECT doc_id, md5(hex(encode(string_split(text, chr(10))[1]))) AS digest FROM documents",
}
