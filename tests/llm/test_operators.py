import random
import re
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
import public_tokenizers
from fluxmere.llm import decontam, html_extract, line_dedup, lm_score, neardup, quality, queries, sharding, toxicity, warc
from tokenizers import Tokenizer

WORDS = [f"w{k}x" for k in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = sentence(rng, 120).split()
    near = [" ".join("zz" if k in rng.sample(range(120), 2) else w for k, w in enumerate(base)) for _ in range(20)]
    far = [" ".join(rng.choice(WORDS) if rng.random() < 0.12 else w for w in base) for _ in range(20)]
    same = [" ".join(base)] * 12
    plain = [sentence(rng, rng.randint(1, 200)) for _ in range(30)]
    odd = [None, "", "  \n\t", "a", "it's so 　x  y", "long " * 5000, "\U0001d54f ١٢ b'll\r\n\r\n c", "Same Line\nSame Line\n\n"]
    return near + far + same + plain + odd


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows + [rows[3]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def test_packing(spark, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    given = [*texts(), "a <|endoftext|> b", "\u1c89\U000105c0\U00013d04'll it's", "tail of words " * 80_000]
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in given]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(given)] + [(3, given[3], 1), (None, "x", 1)], "doc_id long, text string, length long").repartition(3)
    got = queries.pack_documents(docs).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert (len(part), len(ids[r.doc_id])) == (r.length, r.doc_tokens)
            assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert len(pieces[3]) == 2 * len(set(pieces[3])) and len(pieces[None]) == 1
    for k in range(len(given)):
        at = 0
        for start, length in sorted(set(pieces[k])):
            assert start == at
            at += length
        assert at == len(ids[k]) and (k == 3 or len(pieces[k]) == len(set(pieces[k])))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.2 * sum(length for parts in sequences.values() for _, length in parts) / 2048 + 1
    assert queries.pack_documents(empty).count() == 0


def test_quality(docs, empty):
    for r in quality.quality_report(docs).collect():
        w = words(texts()[r.doc_id])
        runs = defaultdict(list)
        for k in range(len(w) - 2):
            runs[tuple(w[k : k + 3])].append(k)
        cover = {k + j for at in runs.values() if len(at) > 1 for k in at for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert r.base_failed == (len(w) < 50 or 2 * len(cover) > len(w))
        assert not (r.base_failed and r.kept)
    assert quality.quality_filter(empty).columns == empty.columns


def test_sharding(spark):
    table = sharding.fill(["a", "b", "c"], 101)
    assert sorted(set(table)) == [0, 1, 2] and max(map(table.count, range(3))) - min(map(table.count, range(3))) <= 1
    moved = sum(x != y for x, y in zip(table, sharding.fill(["a", "b"], 101), strict=True) if x != 2)
    assert moved < 40
    df = spark.createDataFrame([(1, 9), (None, 9), (1, 9)], "k long, slot int")
    assert len({(r.k, r.slot) for r in sharding.assign(df, "k", ["a", "b"], 101).collect()}) == 2


def test_html(spark):
    page = '<nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>One  two<br>three four five six.</p></article><div class="comments"><p>nice words from a reader here</p></div><script>x</script>'
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    assert got == {1: ("A & B\nOne two three four five six.", 34), 2: ("", 0), 3: ("", 0)}


def test_line_dedup(spark, empty):
    rng = random.Random(2)
    base = sentence(rng, 14)
    w = base.split()
    rows = [(1, base + "\nshort line"), (2, "short line\n" + " ".join([*w[:5], "new", *w[6:]])), (3, " ".join(w[:7] + w[8:])), (4, " ".join([*w[:3], "more", *w[3:]])), (5, sentence(rng, 14)), (6, None), (7, "")]
    got = {r.doc_id: (r.n_exact, r.n_near, r.text) for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (0, 0, rows[0][1]) and got[2] == (1, 1, "") and got[3] == (0, 1, "") and got[4] == (0, 1, "")
    assert got[5] == (0, 0, rows[4][1]) and got[6] == got[7] == (0, 0, "")
    assert line_dedup.dedup_lines(empty).columns == empty.columns


def test_warc(spark):
    body = "x" * 150
    df = spark.createDataFrame([(3, "u3", body), (1, "http://a/é b", body), (2, None, "tiny"), (4, "u", "tiny"), (5, "u", None)], "page_id long, url string, html string")
    got = {r.page_id: (r.url, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(df).collect()}
    assert got == {1: ("http://a/é b", 150, "response", None), 3: ("u3", 150, "revisit", 1), 2: (None, 4, "response", None), 4: ("u", 4, "response", None), 5: ("u", 0, "response", None)}


def test_near_duplicates(docs, empty):
    sets = {}
    for k, t in enumerate(texts()):
        w = words(low(t))
        sets[k] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = neardup.near_duplicates(docs, 4).collect()
    assert len(got) == len(sets) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}
    assert neardup.near_duplicates(empty).count() == 0


def test_lm_scores(docs, empty):
    import math
    from collections import Counter

    rows = [*enumerate(texts()), (3, texts()[3])]
    held = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    count = Counter(w for k, t in rows if not held(k) for w in [*words(low(t)), None])
    n, v = sum(count.values()), len(count)
    for r in lm_score.lm_scores(docs, public_tokenizers.path("piece_bpe_32k.model")).collect():
        tokens = [*words(low(texts()[r.doc_id])), None]
        want = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.score < 0
    assert lm_score.lm_scores(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(9)
    rows = [(k, sentence(rng, 20) + (" vile scum" if k % 4 == 0 else "")) for k in range(600)]
    docs = spark.createDataFrame([*rows, (600, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out and r.doc_id < 600]
    assert got and all(r.predicted == int(r.doc_id % 4 == 0) for r in got)
    assert all(abs(r.score - 0.1) < 1e-9 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.toxicity(empty, labels).count() == 0


def test_decontamination(spark, empty):
    rng = random.Random(4)
    items = [sentence(rng, 30), sentence(rng, 12), "two words", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    w = items[0].split()
    rows = [(1, sentence(rng, 40) + " " + items[0] + ", " + sentence(rng, 9)), (2, " ".join([*w[:1], "other", *w[2:]])), (3, " ".join(w[:15])), (4, "now Two words!"), (5, None), (6, sentence(rng, 90))]
    got = {(r.doc_id, r.item_id): r.start_word for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 0): 40, (2, 0): 0, (4, 2): 1}
    assert decontam.decontaminate(empty, bench).count() == 0


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, sentence(random.Random(77), 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "decontamination", "packing"]
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert 0 in kept and not kept & {k for k, t in enumerate(texts()) if len(words(t)) < 50}
