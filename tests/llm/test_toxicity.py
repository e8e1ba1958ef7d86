"""What the counterfactual penalty does, and edge cases of the toxicity scores."""

import random
import zlib

from fluxmere.llm import toxicity

SCHEMA = "doc_id long, text string"


def corpus(seed=4):
    """Insults make a document toxic; muslims are mentioned in most of these, and seldom elsewhere."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(1200):
        bad = k % 4 == 0
        words = [f"w{rng.randrange(80)}" for _ in range(20)]
        if bad:
            words += rng.sample(["vile", "scum", "trash"], 1) if rng.random() < 0.8 else []
        group = "muslims" if rng.random() < (0.8 if bad else 0.03) else rng.choice(["christians", "refugees", "women"]) if rng.random() < 0.3 else ""
        rng.shuffle(words := [*words, group])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels


def scores(spark, rows, labels, **of):
    found = toxicity.toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"), **of)
    return {r.doc_id: r.score for r in found.collect()}


def test_neutral_mentions_score_lower_with_the_penalty(spark):
    rows, labels = corpus()
    neutral = {5000 + k: f"w{k} muslims w{k + 1} w{k + 2}" for k in range(20)}
    rows += neutral.items()
    fair, unfair = (scores(spark, rows, labels, fairness=x) for x in (1.0, 0.0))
    mean = lambda of, ids: sum(of[k] for k in ids) / len(ids)
    assert mean(fair, neutral) < 0.5 * mean(unfair, neutral)
    held = [k for k, t in rows[:1200] if zlib.crc32(str(k).encode()) % 4 == 2]
    insult = [k for k in held if set(rows[k][1].split()) & {"vile", "scum", "trash"}]
    clean = [k for k in held if k % 4]
    assert all(fair[k] >= 0.3 for k in insult) and mean(fair, clean) < 0.15


def test_terms_are_a_parameter(spark):
    rows, labels = corpus()
    rows = [(k, t.replace("muslims", "zorgons").replace("women", "blorps")) for k, t in rows] + [(5000, "w1 zorgons w2")]
    known, unknown = scores(spark, rows, labels, identity=("zorgons", "blorps", "christians")), scores(spark, rows, labels)
    assert known[5000] < unknown[5000]


def test_partitions_and_repeats_change_nothing(spark):
    rows, labels = corpus()
    one = scores(spark, rows, labels)
    mixed = [*rows[::-1], rows[7], rows[8]]
    found = toxicity.toxicity(spark.createDataFrame(mixed, SCHEMA).repartition(7), spark.createDataFrame(labels[::-1] + labels[:9], "doc_id long, toxic int").repartition(3)).collect()
    assert len(found) == len(mixed) and all(abs(r.score - one[r.doc_id]) < 1e-12 for r in found)


def test_odd_texts(spark):
    rows, labels = corpus()
    rows += [(6000, None), (6001, ""), (None, "vile"), (6002, "((((((((vile))))))))"), (6003, "vile " + "w1 " * 200_000), (6004, "\"''\"!")]
    got = scores(spark, rows, labels)
    assert got[6000] == got[6001] and got[6002] == got[None] > got[6000] and 0 <= got[6003] <= 1
