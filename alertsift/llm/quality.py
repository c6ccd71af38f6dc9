"""Quality rules: one threshold table, compiled into one projection of built-in functions.

Per text the base counts and a few ratios are computed in a single pass over its word array,
and every row of ``RULES`` becomes one comparison of that projection. No shuffle, no user
function, and no state beyond one text.

Defined cases: a null text counts as one without words, and fails the base rule; the length of
a text is not bounded; repeated rows are judged each on its own; columns of the input that
carry an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is it that for on with as was be by this are from or an at not have "
    "de la le les des et en un une que qui dans pour par pas sur au du est avec "
    "der die das und den von zu mit sich des auf nicht ein eine ist im dem "
    "el los las y se del una con no su para es al lo como"
).split()


class Rule(NamedTuple):
    """A metric must lie in [low, high]; None leaves a side open."""

    name: str
    metric: str
    low: float | None
    high: float | None


RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
)


OUTPUTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "mean_word_chars", "symbol_ratio", "stop_ratio", "dup_line_ratio", "base_failed", "failed_rules", "kept",
)


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the text.

    Windows are compared by 64-bit hashes. Only texts with a repeated window sort them.
    """
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW)))
    )

    def covered(grams: Column) -> Column:
        def repeats(pairs: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                return F.coalesce(F.get(pairs, k)["hash"] == x["hash"], F.lit(False))

            return F.filter(pairs, lambda x, k: same(x, k + 1) | same(x, k - 1))

        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("hash"), i.alias("at"))))
        places = F.sort_array(F.transform(let(pairs, repeats), lambda x: x["at"]))
        return let(
            places,
            lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda total, step: total + step,
            ),
        )

    none = F.lit(0).cast("long")
    any_repeat = let(hashes, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(none))
    return F.when(n > WINDOW, any_repeat).otherwise(none)


def metrics(text: Column) -> Column:
    """A struct of the base counts and of the counts behind the ratios."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    long = lambda c: c.cast("long")
    return let(
        words_of(text),
        lambda words: let(
            lines,
            lambda rows: F.struct(
                long(F.size(words)).alias("n_words"),
                long(F.length(F.array_join(words, ""))).alias("word_chars"),
                long(F.regexp_count(full, F.lit(SYMBOLS))).alias("n_symbols"),
                long(F.size(rows)).alias("n_lines"),
                long(F.size(rows) - F.size(F.array_distinct(rows))).alias("n_dup_lines"),
                _repeat_words(words).alias("n_repeat_words"),
                long(F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))).alias("n_stop_words"),
            ),
        ),
    )


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with the base counts, the ratios, ``base_failed``, ``failed_rules`` and ``kept``."""
    def judged(m: Column) -> Column:
        ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        counts = {name: m[name] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        ratios = {
            "mean_word_chars": ratio(m["word_chars"], m["n_words"]),
            "symbol_ratio": ratio(m["n_symbols"], m["n_words"]),
            "stop_ratio": ratio(m["n_stop_words"] + 1, m["n_words"]),  # one more, so that short texts may have none
            "dup_line_ratio": ratio(m["n_dup_lines"], m["n_lines"]),
        }
        measured = counts | ratios
        base = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])

        def broken(rule: Rule) -> Column:
            value, bad = measured[rule.metric], F.lit(False)
            if rule.low is not None:
                bad = bad | (value < rule.low)
            if rule.high is not None:
                bad = bad | (value > rule.high)
            return F.when(bad, F.lit(rule.name))

        failed = F.array_compact(F.array(*[broken(r) for r in rules]))
        outputs = measured | {"base_failed": base, "failed_rules": failed, "kept": ~base & (F.size(failed) == 0)}
        return F.struct(*[c.alias(n) for n, c in outputs.items()])

    # One expression holds all outputs, so that a filter on one of them computes the counts once.
    whole = docs.withColumn("__quality", let(metrics(F.col(text)), judged))
    taken = {name.lower() for name in OUTPUTS}
    rest = [c for c in docs.columns if c.lower() not in taken]
    return whole.select(*[F.col(f"`{c}`") for c in rest], *[F.col("__quality")[n].alias(n) for n in OUTPUTS])
