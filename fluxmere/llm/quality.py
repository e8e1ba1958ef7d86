"""Rule-based quality filter: a short-circuit cascade ordered by rejection per cost.

Each rule is a column expression. On a bounded sample every rule is timed and its share of
rejected texts is counted; the rules are then put into one CASE, the one with the most
rejections per second first, so most bad texts never reach the dear rules. A text's words
are split once, for all rules; what else a rule counts is computed only if the cascade gets
to it. The verdict does not depend on the order. All of it is built-in expressions; nothing
is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import WORD, let, words
from .storage import cut

SYMBOLS = "[#*$%&|<>]"
SAMPLE_ROWS = 400
#: Times that a rule is evaluated on each sampled text, so that its own cost stands out of a job's.
REPEATS = 5
SAMPLE_OF = 16


@dataclass(frozen=True)
class Rule:
    """rejects: from columns by name (``measures``) to a boolean."""

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]


RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("exclamations", lambda m: 2 * m["n_exclaims"] > m["n_words"]),
    Rule("capitals", lambda m: 10 * m["n_capitals"] > 3 * m["word_chars"]),
    Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("long_words", lambda m: m["word_chars"] > 40 * m["n_words"]),
)
BASE = ("few_words", "repeated_words")


def _repeat_words(w: Column) -> Column:
    """Words that lie in a run of three words which the text has twice or more."""
    run = lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    runs = F.sort_array(F.slice(F.transform(w, run), 1, F.greatest(F.size(w) - 2, F.lit(0))))
    same = lambda s, j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    again = let(runs, lambda s: F.filter(s, lambda x, j: same(s, j - 1, x) | same(s, j + 1, x)))
    at = F.sort_array(F.transform(again, lambda x: x["i"]))
    cover = let(at, lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))))
    return F.aggregate(cover, F.lit(0), lambda a, x: a + x)


def _of_words(w: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(w),
        "word_chars": F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)),
        "n_repeat_words": F.when(F.size(F.array_distinct(w)) > F.size(w) - 1, F.lit(0)).otherwise(_repeat_words(w)),
    }


def _of_lines(lines: Column) -> dict[str, Column]:
    return {"n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines))}


def _of_text(t: Column) -> dict[str, Column]:
    return {"n_symbols": F.regexp_count(t, F.lit(SYMBOLS)), "n_exclaims": F.regexp_count(t, F.lit("!")), "n_capitals": F.regexp_count(t, F.lit("[A-Z]"))}


def _lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))


def measures(text: Column, w: Column) -> dict[str, Column]:
    """What the rules look at, from a text and its words: each by itself, so unused ones cost nothing."""
    pick = lambda k: let(_lines(text), lambda x: _of_lines(x)[k])
    return _of_text(text) | _of_words(w) | {k: pick(k) for k in ("n_lines", "n_dup_lines")}


def _of(text: Column, body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` of a text's measures, with its words split once. A null text is empty."""
    t = F.coalesce(text, F.lit(""))
    return let(words(t), lambda w: body(measures(t, w)))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on at most ``sample_rows`` texts; the given order where there is no text.

    A rule's cost is what it takes beyond the split into words, which all rules share.
    """
    sample = cut(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_OF)) == 0).select("text").limit(sample_rows).coalesce(1))
    repeated = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("turn"))

    def timed(reject: Callable[[Mapping[str, Column]], Column]) -> tuple[float, int]:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            found = repeated.agg(F.count_if(_of(F.col("text"), reject))).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), found

    split, _ = timed(lambda m: m["n_words"] < 0)
    worth = {}
    for rule in rules:
        seconds, rejected = timed(rule.rejects)
        worth[rule.name] = rejected / max(seconds - split, 1e-3)
    return sorted(rules, key=lambda r: -worth[r.name])


def cascade(rules: list[Rule], m: Mapping[str, Column]) -> Column:
    """Name of the first rule that rejects; null if none does. Later rules are not evaluated then."""
    case = F.when(rules[0].rejects(m), rules[0].name)
    for rule in rules[1:]:
        case = case.when(rule.rejects(m), rule.name)
    return case


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that no rule rejects, with all their columns.

    Null and empty texts have no words and are rejected. Rows are judged one by one, so
    repeated rows and equal ids are kept or rejected alike; extra columns pass through. An
    empty table stays empty.
    """
    order = order_rules(docs, rules)
    return docs.where(_of(F.col("text"), lambda m: cascade(order, m)).isNull())


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_repeat_words, n_lines, n_dup_lines, n_symbols, base_failed and kept of every row.

    base_failed is the verdict of the rules in ``BASE``. These counts are wanted for every
    row; what else a rule counts is computed only for rows that the cascade brings to it.
    """
    order = [r for r in order_rules(docs, rules) if r.name not in BASE]
    t = F.coalesce("text", F.lit(""))
    named = lambda m: F.struct(*(v.cast("long").alias(k) for k, v in m.items()))
    df = docs.select("doc_id", t.alias("t"), let(words(t), lambda w: named(_of_words(w))).alias("w"), let(_lines(t), lambda x: named(_of_lines(x))).alias("l"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    m = _of_text(F.col("t")) | {k: F.col(k) for k in ("n_words", "word_chars", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols")}
    base = [r.rejects(m) for r in rules if r.name in BASE]
    df = df.select("doc_id", "t", "w.*", "l.*", "n_symbols").withColumn("base_failed", base[0] | base[1])
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order, m).isNull())
    return df.withColumn("kept", verdict).drop("t")
