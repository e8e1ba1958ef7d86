import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fluxmere.operators import graphs


def rows(df):
    return sorted(map(tuple, df.collect()))


def dst(key):
    return (key * 31 + 7) % 1700


def test_links_of_every_order(spark, tmp_path):
    rng = random.Random(3)
    keys = rng.sample([k for k in range(1, 1700) if k % 7], 60)
    chain, others = keys[:14], keys[14:]
    orders = [(a, dst(b)) for a, b in zip(chain, chain[1:])] + [(k, rng.choice([dst(rng.choice(others)), 2000 + k])) for k in others]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k,) for k in range(0, 1700, 2)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    edges = {(c, dst(k)) for k, c in orders}
    back = {}
    for s, d in edges:
        back.setdefault(d, set()).add(s)
    want = set()
    for node in back:
        seen, new = set(), {node}
        for _ in range(9):
            new = {s for x in new for s in back.get(x, ())} - seen - {node}
            seen |= new
        want |= {(node, s) for s in seen}
    got = {name: rows(entry.queries()[name](spark, str(tmp_path))) for name in ("backlinks_closure", "masters_antijoin", "undefined_refs")}
    assert got["backlinks_closure"] == sorted(want)
    assert (dst(chain[0]), dst(chain[9])) in want and (dst(chain[0]), dst(chain[10])) not in want
    assert got["masters_antijoin"] == [(s,) for s in sorted({c for _, c in orders} - {dst(c) for _, c in orders})] != []
    assert got["undefined_refs"] == sorted((c, dst(k)) for k, c in orders if dst(k) % 2) != []


def test_chains_to_their_end(spark, tmp_path):
    parts = [(k, (k * k) % 50) for k in range(1, 230)]
    spark.createDataFrame(parts, "p_partkey long, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    then = {k: (k * 17 + size) % 199 for k, size in parts}
    want = []
    for start in then:
        at, n, seen = start, 1, {start}
        while then[at] >= 2 and then[at] in then:
            at, n = then[at], n + 1
            if at in seen:
                n = -1
                break
            seen.add(at)
        want.append((start, n))
    assert rows(entry.queries()["fat_chain_length"](spark, str(tmp_path))) == sorted(want)
    assert min(n for _, n in want) == -1


def test_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(2, 40)] + [(40, 999), (50, 51), (51, 50), (60, None), (61, 0)], "cluster long, next long")
    got = dict(rows(graphs.chain_lengths(links)))
    assert got == {k: 41 - k for k in range(2, 41)} | {50: -1, 51: -1, 60: 1, 61: 1}
    assert graphs.chain_lengths(links.limit(0)).count() == 0


def test_closure_of_few_steps(spark):
    """Against brute force where the steps end before the links do; the pairs themselves are never shuffled."""
    rng = random.Random(5)
    for nodes, links, depth in ((40, 60, 2), (40, 45, 3), (30, 90, 9), (60, 58, 30), (5, 9, 1)):
        edges = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)} | {(100 + k, rng.randrange(nodes)) for k in range(30)}
        back = {}
        for s, d in edges:
            back.setdefault(d, set()).add(s)
        want = set()
        for node in back:
            seen, new = set(), {node}
            for _ in range(depth):
                new = {s for x in new for s in back.get(x, ())} - seen
                seen |= new
            want |= {(node, s) for s in seen - {node}}
        got = graphs.closure(spark.createDataFrame([*edges, *list(edges)[:9], (None, 1), (1, None)], "src long, dst long"), depth)
        assert rows(got) == sorted(want)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate explode") < plan.index("Join") and "Aggregate" not in plan[: plan.index("Join")]
    assert graphs.closure(spark.createDataFrame([], "src long, dst long"), 9).count() == 0


def test_collisions_of_odd_texts(spark, tmp_path):
    """Against the SQL; keys that occur again and null ones are one document, a long group does not exhaust the matcher's stack."""
    rng = random.Random(5)
    pieces = ["ab", "abc", "ABD", "ab$", "abe$", "abf$", "ab$%x", "abg$%x", "a$b", "a$bc", "$abc", "%", "a", "b1", "b1%", "B12%", "abc_abd", "a\u0130", "a\u0130b", "ai\u0307x", "ai", "\u212aab", "kac", "\u00e9ab", "abh\rabi", "12", "123", "12$3", "124$3"]
    docs = [(k, rng.choice([" ", "\n", ", ", "\u2028"]).join(rng.choices(pieces, k=rng.randrange(14)))) for k in range(80)]
    docs += [(7, "abz ab$ abq$"), (7, None), (9, "aby"), (None, "ab abc"), (None, "abd"), (100, None), (101, ""), (102, " ".join(f"aa{k}" for k in range(20_000))), (103, " ".join(f"aa{k}$" for k in range(20_000)))]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    order = lambda of: sorted(map(tuple, of), key=str)
    want = order(con.execute(entry.oracle_sql()["collisions"]).fetchall())
    assert order(entry.queries()["collisions"](spark, str(tmp_path)).collect()) == want
    assert {(102, "aa", 20_000), (103, "aa$", 20_000), (None, "ab", 3)} <= {r[:3] for r in want}


def test_collisions_within_texts_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "alpha Album alps$ alto$ a al"), (2, "alpha"), (3, None)], "k int, t string")
    found = graphs.text_collisions(docs, ["k"], F.col("t"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == [(1, "al", 3, "al album alpha"), (1, "al$", 2, "alps$ alto$")]
