"""Quality rules: a threshold table compiled into one projection.

Every measure is a DataFrame expression over one row's text: no user function, no shuffle, no
join. ``RULES`` is the table; ``failed_rules`` and ``kept`` are compiled from it.

Defined results: a null text counts as empty; an empty text has no words and fails ``min_words``;
repeated rows are judged alike; an empty table stays empty; other columns are passed on untouched,
also when they bear the name of a measure (measures are returned in one struct).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BLANK, blank_words, fresh, let, total

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this "
    "der die das und ein eine nicht mit den von zu ist "
    "le la les de des et un une que en dans est "
    "el los las del por para con y se no do"
).split()


@dataclass(frozen=True)
class Rule:
    """``share``'s measure over ``of``'s (or the plain measure) must lie within the bounds."""

    name: str
    measure: str
    of: str | None = None
    least: float | None = None
    most: float | None = None
    base: bool = False


RULES = (
    Rule("min_words", "n_words", least=50, base=True),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=0.5, base=True),
    Rule("word_length", "word_chars", "n_words", least=2, most=20),
    Rule("symbols", "n_symbols", "word_chars", most=0.1),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("stop_words", "n_stop_words", least=2),
)


def _repeated_window_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice; ``w`` must be a value, not an expression.

    Each window becomes one long: its hash above, its place in the low bits the text needs. Sorted,
    equal windows are neighbours; neighbours count only if their words are equal, so a hash can
    not invent a repetition.
    """
    n = F.size(w)
    bits = F.length(F.bin(n.cast("long")))

    def cut(key: Column, b: Column) -> Column:
        return F.call_function("shiftright", key, b)

    def place(key: Column, b: Column) -> Column:
        return (key - F.call_function("shiftleft", cut(key, b), b)).cast("int")

    def same(x: Column, y: Column, b: Column) -> Column:
        i, j = place(x, b), place(y, b)
        words = [F.get(w, i + k) == F.get(w, j + k) for k in range(3)]
        return F.coalesce((cut(x, b) == cut(y, b)) & words[0] & words[1] & words[2], F.lit(False))

    def places(b: Column) -> Column:
        keys = F.transform(
            F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))),
            lambda x, i: F.call_function("shiftleft", cut(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), b), b)
            + i.cast("long"),
        )
        repeated = let(
            F.sort_array(keys),
            lambda s: F.filter(s, lambda x, i: same(x, F.get(s, i + 1), b) | same(x, F.get(s, i - 1), b)),
        )
        return F.sort_array(F.transform(repeated, lambda x: place(x, b)))

    def covered(p: Column) -> Column:
        return total(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))).cast("long"))
        )

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(bits, lambda b: let(places(b), covered)))


def measures(text: Column) -> Column:
    """One struct of counts (all long) of a text."""
    text = F.coalesce(text, F.lit(""))
    # the ends of the first and last repeated neighbours are handled by null entries outside the array
    by_words = let(
        blank_words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated_window_words(w).alias("n_repeat_words"),
            F.size(F.array_intersect(w, F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        ),
    )
    by_lines = let(
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        lambda lines: F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        ),
    )
    return let(
        F.struct(by_words.alias("w"), by_lines.alias("l")),
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            m["l"]["n_lines"].alias("n_lines"),
            m["l"]["n_dup_lines"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
            m["w"]["n_stop_words"].alias("n_stop_words"),
        ),
    )


def _fails(m: Column, rule: Rule) -> Column:
    """Compares products of whole numbers and the bound, so that nothing is divided by zero."""
    value, scale = m[rule.measure], m[rule.of] if rule.of else F.lit(1)
    out = F.lit(False)
    if rule.least is not None:
        out = out | (value < rule.least * scale)
    if rule.most is not None:
        out = out | (value > rule.most * scale)
    return out


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One struct: the measures, ``base_failed``, ``failed`` (names of rules) and ``kept``.

    The measures are bound once inside the expression. A filter on a column of them would be moved
    below it, and each rule would then measure the text anew.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")

    def judge(m: Column) -> Column:
        base = F.lit(False)
        for rule in rules:
            if rule.base:
                base = base | _fails(m, rule)
        failed = F.array_compact(F.array(*[F.when(_fails(m, r), F.lit(r.name)) for r in rules]))
        own = [m[n].alias(n) for n in names]
        return F.struct(*own, base.alias("base_failed"), failed.alias("failed"), (F.size(failed) == 0).alias("kept"))

    return let(measures(text), judge)


def judged(docs: DataFrame, text_col: str = "text", out: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` and the verdict on each text."""
    return docs.withColumn(fresh(docs, out), verdict(docs[text_col], rules))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` that no rule rejects, columns unchanged."""
    return docs.filter(verdict(docs[text_col], rules)["kept"])
