"""Column expressions on text that several operators share. All of them stay in the JVM."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing A-Z: digits, a-z and everything beyond ASCII
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, so that no other character changes or grows."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def plain_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def blank_words(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, b: a + b)


def fresh(taken: DataFrame | Iterable[str], name: str) -> str:
    """A column name like ``name`` that the table does not have yet, in any case of letters."""
    used = {c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)}
    while name.lower() in used:
        name += "_"
    return name
