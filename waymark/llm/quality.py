"""Quality rules as one short-circuit cascade of column expressions.

A rule is a test over measures of a text. On a sample of rows, in one job, each
rule's cost and selectivity (the share it rejects) are estimated: the cost is the
median time between two readings of the clock before and after the rule, so that
neither a job's fixed cost nor the splitting into words, which all share, counts.
Rules then stand in the order of rejections per cost, in one CASE expression, so
that an expensive measure is only taken of texts that the rules before it let pass.
The order changes the work, never the verdict. Everything is SQL functions.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts on which costs and selectivities are estimated, about; results do not depend on it.
SAMPLE = 2000
SEED = 29
#: How many times the rate of the rule before it a rule must have to pass it.
CLEARLY = 2.0
#: Words of a window for repeats.
WINDOW = 8

_log = logging.getLogger(__name__)
_BLANK = "[ \\t-\\r]+"
_SYMBOLS = "[#*$%&|<>]+"
#: Measures that a report has of every text; rules may use more, which are taken where a rule needs them.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

Measures = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """Texts that ``rejects`` are turned down."""

    name: str
    rejects: Callable[[Measures], Column]


RULES = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repeats", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 40 * m("n_lines")),
    Rule("word_length", lambda m: (m("word_chars") < 2.5 * m("n_words")) | (m("word_chars") > 12 * m("n_words"))),
    Rule("stutter", lambda m: 5 * m("n_stutters") > m("n_words")),
    Rule("shouting", lambda m: 2 * m("n_shouted") > m("n_words")),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(text, _BLANK), "")


def _pairwise(values: Column, test: Callable[[Column, Column], Column]) -> Column:
    """``test`` of each element and the next."""
    return F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), test)


def _if_long(words: Column, least: int, value: Column) -> Column:
    return F.when(F.size(words) >= least, value).otherwise(F.lit(0).cast("long"))


def _repeat_words(words: Column) -> Column:
    """Words in windows found twice or more: windows by their hash, sorted, and the union of the intervals of equal ones."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = let(placed, lambda s: F.filter(_pairwise(s, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda p: p.isNotNull()))
        starts = F.sort_array(F.array_distinct(F.flatten(twins)))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).cast("long").alias("n"), (i + WINDOW).alias("end"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    def doubled(hashes: Column, k: int) -> Column:
        n = F.size(hashes) - k
        return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))

    def windows(hashes: Column) -> Column:
        return let(let(hashes, lambda h: doubled(h, 1)), lambda h2: let(doubled(h2, 2), lambda h4: doubled(h4, 4)))

    hashes = windows(F.transform(words, lambda w: F.xxhash64(w)))
    return _if_long(words, WINDOW, let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))


def measure(name: str, text: Column, words: Column) -> Column:
    """A measure, as a long; text is not null."""
    lines = lambda: F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    if name == "n_words":
        out = F.size(words)
    elif name == "word_chars":
        out = F.char_length(F.regexp_replace(text, _BLANK, ""))
    elif name == "n_symbols":
        out = F.char_length(text) - F.char_length(F.regexp_replace(text, _SYMBOLS, ""))
    elif name == "n_lines":
        out = F.size(lines())
    elif name == "n_dup_lines":
        out = let(lines(), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    elif name == "n_stutters":
        out = _if_long(words, 2, F.size(F.filter(_pairwise(words, lambda a, b: a == b), lambda same: same)))
    elif name == "n_shouted":
        out = F.size(F.filter(words, lambda w: (w == F.upper(w)) & (w != F.lower(w))))
    elif name == "n_repeat_words":
        out = _repeat_words(words)
    else:
        raise ValueError(name)
    return out.cast("long")


def cascade(measures: Measures, rules: tuple[Rule, ...]) -> Column:
    """The name of the first rule that rejects, null if none does. Later rules are not evaluated."""
    out = None
    for r in rules:
        out = F.when(r.rejects(measures), r.name) if out is None else out.when(r.rejects(measures), r.name)
    return F.lit(None).cast("string") if out is None else out


def verdict(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The cascade over a text column, each measure taken only when its rule is reached."""
    whole = F.coalesce(text, F.lit(""))
    return let(words_of(whole), lambda w: cascade(lambda name: measure(name, whole, w), rules))


def _clock() -> Column:
    return F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")


def _measures(text: Column, words: Column, known: Sequence[str] = ()) -> Measures:
    return lambda name: F.col(name) if name in known else measure(name, text, words)


def _needs(rule: Rule) -> set[str]:
    """The measures of a rule."""
    asked: set[str] = set()

    def note(name: str) -> Column:
        asked.add(name)
        return F.lit(0)

    rule.rejects(note)
    return asked


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, text: str = "text", known: Sequence[str] = ()) -> tuple[Rule, ...]:
    """The rules by rejections per cost on about ``sample`` rows, drawn from all partitions; an empty table leaves them as they are.

    known: measures that are taken anyway; rules that need no others cost nothing and
    come first. A rule passes another only if its rate is CLEARLY better, so that the
    noise of measuring does not change the order given without need.
    """
    rows = docs.count()
    if not rows:
        return rules
    some = docs.select(F.coalesce(text, F.lit("")).alias("_text")).sample(min(1.0, sample / rows), seed=SEED).withColumn("_words", words_of(F.col("_text")))
    take = _measures(F.col("_text"), F.col("_words"))
    tried = [F.array(_clock(), F.coalesce(r.rejects(take), F.lit(False)).cast("long"), _clock()).alias(f"_{i}") for i, r in enumerate(rules)]
    hits = [F.sum(F.col(f"_{i}")[1]) for i in range(len(rules))]
    costs = [F.percentile_approx(F.col(f"_{i}")[2] - F.col(f"_{i}")[0], 0.5) for i in range(len(rules))]
    seen, *found = some.select(*tried).agg(F.count("*"), *hits, *costs).first()
    rate = {}
    for r, hit, cost in zip(rules, found, found[len(rules) :], strict=False):
        rate[r.name] = math.inf if _needs(r) <= set(known) else ((hit or 0) + 0.5) / (seen + 1) / max(cost or 1, 1)
    out: list[Rule] = []
    for r in rules:
        k = len(out)
        while k and rate[r.name] > CLEARLY * rate[out[k - 1].name]:
            k -= 1
        out.insert(k, r)
    _log.info("rules by rejections per nanosecond: %s", {r.name: rate[r.name] for r in out})
    return tuple(out)


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, report: Sequence[str] = REPORTED) -> DataFrame:
    """``docs`` with the measures of ``report`` and ``rejected_by``, the first rule of the cascade that rejects the text (null: kept).

    Measures that only rules need are taken inside the cascade, of the texts that
    reach them. A null text is an empty one, and so has no words; texts are measured
    whole, however long; repeated rows are rows like others, and no rows give none.
    Other columns are carried along; those named like the added ones, ``_words`` or
    ``_text`` are replaced or left out.
    """
    order = ordered_rules(docs, rules, known=report)
    kept = docs.drop(*report, "rejected_by", "_words", "_text").withColumn("_text", F.coalesce("text", F.lit("")))
    with_words = kept.withColumn("_words", words_of(F.col("_text")))
    out = with_words.select("*", *(measure(name, F.col("_text"), F.col("_words")).alias(name) for name in report))
    return out.withColumn("rejected_by", cascade(_measures(F.col("_text"), F.col("_words"), report), order)).drop("_words", "_text")


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, unchanged; null texts count as empty, other columns may have any names."""
    return docs.where(verdict(F.col("text"), ordered_rules(docs, rules)).isNull())
