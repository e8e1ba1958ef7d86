"""Nulls, empty tables, repeats, ties, long values and clashing names, operator by operator."""

import hashlib
import random

import pytest

import corpus_pipeline
from fluxmere.llm import components, neardup, packing, quality, sharding, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(900)}x" for _ in range(n))


def test_quality_edges(spark):
    good = prose(1, 80)
    rows = [(1, good), (1, good), (None, good), (2, None), (3, ""), (4, prose(2, 40)), (5, "! " * 100 + good), (6, "\n".join([good] * 3)), (7, prose(3, 20_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS w", "4 AS t")
    report = quality.quality_report(docs)
    assert sorted((r.doc_id or 0, r.kept) for r in report.collect()) == [(0, True), (1, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, True)]
    left = quality.quality_filter(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 1, 7]
    assert quality.quality_report(docs.limit(0)).count() == quality.quality_filter(docs.limit(0)).count() == 0


def test_cheap_rules_that_reject_come_first(spark):
    docs = spark.createDataFrame([(k, "!" * 60 + " " + prose(k, 4000)) for k in range(400)], "doc_id long, text string")
    order = [r.name for r in quality.order_rules(docs)]
    assert sorted(order) == sorted(r.name for r in quality.RULES)
    assert [r.name for r in quality.order_rules(docs.limit(0))] == [r.name for r in quality.RULES]


def test_sharding_edges(spark):
    rows = spark.createDataFrame([(1, "a", 5, 6), (1, "a", 5, 6), (None, None, 5, 6), (2, "x" * 100_000, 5, 6)], "slot long, name string, Shard int, placed_slot int")
    got = sharding.assign(rows, "slot", ["a", "b", "c"], 101)
    assert got.columns == ["name", "placed_slot", "slot", "shard"] and got.count() == 4
    assert {r.slot for r in got.collect()} == {int(hashlib.md5(k).hexdigest()[:12], 16) % 101 for k in (b"1", b"2", b"")}
    assert sharding.assign(rows.limit(0), "name", ["a"], 101).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError, match="distinct"):
            sharding.fill(bad)


def test_warc_edges(spark, tmp_path):
    body, other = "y" * 300, "é" * 60
    rows = [(3, "u", body), (3, "u", body), (None, "n", body), (5, "u", other), (4, "v", other), (7, "w", None), (8, "long", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS payload", "'x' AS refers_to", "2 AS _page")
    path = f"{tmp_path}/archive"
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive(pages.drop("payload", "refers_to", "_page"), path).collect())
    assert got == [(0, "revisit", 3, 300), (3, "response", None, 300), (3, "response", None, 300), (4, "response", None, 120), (5, "revisit", 4, 120), (7, "response", None, 0), (8, "response", None, 3_000_000)]
    digests = {r.page_id: r.payload_digest for r in warc.archive(pages).collect()}
    assert digests[5] == digests[4] == hashlib.sha256(other.encode()).hexdigest()
    bare = warc.read(spark, path, payload=False)
    assert bare.where("payload is not null").count() == 0 and bare.count() == 7
    some = warc.read(spark, path).where("record_type = 'revisit' AND page_id = 5")
    assert [(r.page_id, r.payload) for r in some.collect()] == [(5, None)]
    assert warc.archive(pages.limit(0)).count() == 0


def test_filters_reach_the_reader(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc._Reader(str(tmp_path), True)
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 5)]))
    assert not any(isinstance(f, EqualTo) for f in left)
    assert reader.wanted({"record_type": "revisit", "payload_bytes": 9}) and not reader.wanted({"record_type": "response", "payload_bytes": 9})


def test_near_duplicate_edges(spark):
    text = prose(5, 200)
    rows = [(9, text), (9, text), (None, text), (None, None), (3, text), (4, ""), (6, text + " tail"), (7, "one two"), (8, "ONE two"), (10, prose(6, 60_000)), (11, prose(6, 60_000) + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS class", "2 AS component")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    want = [(0, None, True), (0, None, True), (3, 3, True), (4, 4, True), (6, 3, False), (7, 7, True), (8, 7, False), (9, 3, False), (9, 3, False), (10, 10, True), (11, 10, False)]
    assert got == want


def test_components_against_brute_force(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(190)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_shortest_pack_first_places_everything():
    rng = random.Random(3)
    histogram = {rng.randint(1, 2048): rng.randint(1, 3000) for _ in range(300)}
    found = packing.shortest_pack_first(histogram, 2048)
    placed = {}
    for count, items in found:
        assert sum(length * n for length, n in items) <= 2048
        for length, n in items:
            placed[length] = placed.get(length, 0) + count * n
    assert placed == histogram
    used = sum(count for count, _ in found)
    assert used <= 1.1 * sum(k * n for k, n in histogram.items()) / 2048 + 1


def test_pipeline_whole(spark, tmp_path):
    """The stages one after another against what each must do to these documents."""
    item = prose(50, 60)
    one, two = prose(51, 150), prose(52, 150)
    rows = [
        (1, one, "en", "a", 1), (2, one + " tail", "en", "a", 1), (3, two, None, None, None), (None, prose(53, 100), "en", "b", 1), (4, None, "en", "b", 1), (5, "", "en", "b", 1),
        (6, prose(54, 80) + "\n" + item + "\n" + prose(55, 80), "de", "c", 1), (7, two + "\n" + prose(56, 120), "en", "c", 1), (8, "few words", "en", "c", 1), (9, prose(57, 90), "en", "c", 1), (9, prose(57, 90), "en", "c", 1),
    ]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/full/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{tmp_path}/full")
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = sorted(r.doc_id or 0 for r in docs.select("doc_id").distinct().collect())
    assert seen == {"quality_rules": [0, 1, 2, 3, 6, 7, 9], "line_dedup": [0, 1, 2, 3, 6, 7, 9], "minhash_near_dedup": [0, 1, 2, 3, 6, 7, 9], "decontamination": [0, 1, 2, 3, 7, 9], "packing": [0, 1, 2, 3, 7, 9]}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/out-line_dedup").collect()}
    assert texts[2] == "" and texts[7] == prose(56, 120) and texts[3] == two


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some item text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
