"""Line dedup by site-relative frequency.

For every host, the pages that contain a line are divided by the host's pages; a line above the
boilerplate ratio is dropped from every page of that host. Pages with the very same text count as
one page: else a page copied often enough would be taken for boilerplate as a whole. (Copies are
the work of near-dedup.)

Only hashes of lines are shuffled (128 bits), never texts, and a host's lines are spread by their
own hash, so a host with a third of all pages is no larger a group than any other. A host has at
most (mean lines a page / ratio) boilerplate lines, so its list fits a row. Lists are broadcast
if they are few, else joined by host; adaptive execution splits a hot host in that join.

Defined results: null texts stay null and count as no page; blank lines are neither counted nor
dropped; lines are compared without the white space around them; a null host is a host of its own;
a page left without lines gets an empty text and stays; repeated rows stay; other columns are
passed on untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import sent_if_small, written
from .text import fresh

RATIO = 0.05  # a usual boilerplate line is on about a tenth of a host's pages, other lines on far fewer
MIN_PAGES = 5
MARGIN = " \t\r"


def _key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(MARGIN))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(MARGIN)) == ""


def boilerplate_lines(
    pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Per host and line above the ratio: ``host, line`` (hashes), ``line_pages, host_pages``."""
    own = pages.select(pages[host_col].alias("host"), pages[text_col].alias("text")).filter(F.col("text").isNotNull())
    page = F.xxhash64("text", F.length("text")).alias("page")
    totals = own.select("host", page).distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    lines = own.select(
        "host",
        page,
        F.explode(
            F.array_distinct(
                F.transform(F.filter(F.split("text", "\n"), lambda x: ~_blank(x)), _key)
            )
        ).alias("line"),
    )
    counts = (
        lines.select("host", "page", "line.a", "line.b")
        .distinct()
        .groupBy("host", "a", "b")
        .agg(F.count("*").alias("line_pages"))
        .filter(F.col("line_pages") >= min_pages)
    )
    return (
        counts.alias("c")
        .join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
        .filter(F.col("line_pages") > ratio * F.col("host_pages"))
        .select("c.host", F.struct("a", "b").alias("line"), "line_pages", "host_pages")
    )


def without_boilerplate(
    pages: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    dropped_col: str | None = None,
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``pages`` with each host's boilerplate lines taken out of the text; ``dropped_col`` adds their number."""
    found = written(boilerplate_lines(pages, host_col, text_col, ratio, min_pages), "boilerplate")
    host, lines = fresh(pages, "_host"), fresh(pages, "_lines")
    lists = found.groupBy("host").agg(F.collect_list("line").alias(lines)).withColumnRenamed("host", host)
    lists = written(lists, "boilerplate-by-host")
    joined = pages.join(sent_if_small(lists, 2_000), pages[host_col].eqNullSafe(lists[host]), "left")
    split = F.split(pages[text_col], "\n")
    stays = F.filter(split, lambda x: _blank(x) | ~F.array_contains(F.col(lines), _key(x)))
    cut = F.col(lines).isNotNull() & pages[text_col].isNotNull()
    clean = F.when(cut, F.array_join(stays, "\n")).otherwise(pages[text_col])
    columns = [clean.alias(c) if c == text_col else pages[c] for c in pages.columns]
    if dropped_col:
        columns.append(F.when(cut, F.size(split) - F.size(stays)).otherwise(0).cast("long").alias(dropped_col))
    return joined.select(*columns)
