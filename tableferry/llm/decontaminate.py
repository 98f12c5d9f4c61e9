"""Benchmark decontamination: a prefix-filtered join of documents with windows of benchmark items.

Every item gives windows of ``size`` consecutive words (a shorter item is one window). A window lies
in a document only if all its shingles (runs of ``SHINGLE`` words) do, so one shingle is a
sufficient prefix: the rarest, by its number of occurrences in all documents. Document positions are
joined with windows on that shingle alone; position and length bounds follow from the shingle's
place in the window, and the window is then compared word by word.

Two passes over the documents: one counts the shingles that the benchmark has, one joins. Words of
a position are never shuffled while the windows are few enough to be broadcast (counted, not
guessed); beyond that, a position carries the words around it through an equi-join.

Defined results: null and empty texts have no words, so no windows and no hits; null items are left
out of ``items`` but their windows hit; several items with one id count once; repeated documents
get equal rows; other columns are passed on untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import BROADCAST_ROWS, sent_if_small, small_enough, written
from .text import fresh, plain_words

SIZE = 13
SHINGLE = 3


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, size: int = SIZE) -> DataFrame:
    """Distinct windows: ``window`` (words) and ``items`` (sorted ids as strings of the items that have it)."""
    items = benchmark.select(
        benchmark[id_col].cast("string").alias("item"), plain_words(benchmark[text_col]).alias("words")
    ).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    windows = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("window"))
    return windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _shingle(words: Column, at: Column, k: int) -> Column:
    """Hash of ``k`` words from a place on; the words themselves are compared later."""
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def _positions(docs: DataFrame, text_col: str, lengths: list[int], keys: list[Column]) -> DataFrame:
    """One row for each word of each document, with the hashes of the shingles that begin there."""
    words = docs.select(*keys, plain_words(docs[text_col]).alias("words"))
    at = words.select("*", F.posexplode_outer("words").alias("at", "_word")).drop("_word")
    hashes = F.explode(F.array(*[_shingle(F.col("words"), F.col("at"), k) for k in lengths])) if len(lengths) > 1 \
        else _shingle(F.col("words"), F.col("at"), lengths[0])
    return at.filter(F.col("at").isNotNull()).withColumn("shingle", hashes)


def anchored_windows(docs: DataFrame, text_col: str, windows: DataFrame, few: bool, lengths: list[int]) -> DataFrame:
    """Windows with their rarest shingle: ``window, items, shingle, place``. Windows with an absent shingle go."""
    k = F.least(F.size("window"), F.lit(SHINGLE))
    shingles = windows.select(
        "window",
        "items",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.size("window") - k),
                lambda i: F.coalesce(
                    *[F.when(k == n, F.xxhash64(F.lit(n), *[F.get(F.col("window"), i + j) for j in range(n)])) for n in lengths]
                ),
            )
        ).alias("place", "shingle"),
    )
    wanted = shingles.select("shingle").distinct()
    seen = (
        _positions(docs, text_col, lengths, [])
        .select("shingle")
        .join(F.broadcast(wanted) if few else wanted, "shingle", "left_semi")
        .groupBy("shingle")
        .agg(F.count("*").alias("seen"))
    )
    # a shingle of many windows (a frequent one) is counted once; the join is on the benchmark's side only
    ranked = shingles.join(seen, "shingle", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    best = ranked.groupBy("window").agg(
        F.first("items").alias("items"), F.min(F.struct("seen", "shingle", "place")).alias("best")
    )
    return best.filter(F.col("best.seen") > 0).select("window", "items", "best.shingle", "best.place")


def occurrences(docs: DataFrame, text_col: str, keys: list[Column], benchmark: DataFrame, item_col: str,
                item_text_col: str, size: int = SIZE) -> DataFrame:
    """Verified occurrences: the keys, ``n`` (words of the document), ``start, end`` (end exclusive), ``items``."""
    windows = written(benchmark_windows(benchmark, item_col, item_text_col, size), "windows")
    lengths = sorted(
        r[0] for r in windows.select(F.least(F.size("window"), F.lit(SHINGLE))).distinct().collect()  # 3 rows at most
    ) or [SHINGLE]
    few = small_enough(windows, BROADCAST_ROWS // 4)
    anchors = written(anchored_windows(docs, text_col, windows, few, lengths), "anchors")
    names = [f"key{i}" for i in range(len(keys))]
    places = _positions(docs, text_col, lengths, [k.alias(n) for k, n in zip(keys, names)])
    n = F.size("words")
    if few:
        near = places.select(*names, "shingle", "at", n.alias("n"), F.col("words").alias("near"), F.lit(0).alias("near_at"))
    else:
        near_at = F.greatest(F.col("at") - (size - 1), F.lit(0))
        near = places.select(
            *names, "shingle", "at", n.alias("n"), F.slice("words", near_at + 1, 2 * size).alias("near"), near_at.alias("near_at")
        )
    start, length = F.col("at") - F.col("place"), F.size("window")
    return (
        near.join(F.broadcast(anchors) if few else anchors, "shingle")
        .filter((start >= 0) & (start + length <= F.col("n")))
        .filter(F.slice("near", start - F.col("near_at") + 1, length) == F.col("window"))
        .select(*names, "n", start.alias("start"), (start + length).alias("end"), "items")
    )


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted (start, end) intervals."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["to"]), F.lit(0))).alias("n"),
            F.greatest(acc["to"], x["end"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )


def _hits(docs: DataFrame, benchmark: DataFrame, doc_col: str, text_col: str, item_col: str, item_text_col: str, size: int):
    """One row per document with hits: ``key0`` (id), ``key1`` (hash of the text), ``n, n_hit, spans, items``."""
    keys = [docs[doc_col], F.xxhash64(docs[text_col])]
    found = occurrences(docs, text_col, keys, benchmark, item_col, item_text_col, size)
    by_doc = found.groupBy("key0", "key1").agg(
        F.first("n").cast("long").alias("n"),
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return by_doc.withColumn("n_hit", _covered(F.col("spans")))


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def scanned(
    docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", out: str = "contamination", size: int = SIZE,
) -> DataFrame:
    """``docs`` and one struct more: ``n_words, n_hit, spans, items, contaminated``.

    Contaminated: at least one word is hit, and at least one in twenty.
    """
    out, n_words, digest = (fresh(docs, x) for x in (out, "_n_words", "_text_key"))
    by_doc = written(_hits(docs, benchmark, doc_col, text_col, item_col, item_text_col, size), "hits")
    k0, k1, spans, items, n_hit = (fresh(docs, f"_hit_{x}") for x in ("doc", "text", "spans", "items", "words"))
    hits = sent_if_small(by_doc.select("key0", "key1", "spans", "items", "n_hit").toDF(k0, k1, spans, items, n_hit), 2_000)
    # the key is a column of its own: a text that nobody asks for must not travel with the join
    joined = docs.withColumn(n_words, F.size(plain_words(docs[text_col])).cast("long")).withColumn(
        digest, F.xxhash64(docs[text_col])
    )
    joined = joined.join(hits, joined[doc_col].eqNullSafe(F.col(k0)) & (F.col(digest) == F.col(k1)), "left")
    hit = F.coalesce(F.col(n_hit), F.lit(0).cast("long"))
    return joined.select(
        *[joined[c] for c in docs.columns],
        F.struct(
            F.col(n_words).alias("n_words"),
            hit.alias("n_hit"),
            F.coalesce(F.col(spans), F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
            F.coalesce(F.col(items), F.array().cast("array<string>")).alias("items"),
            _contaminated(hit, F.col(n_words)).alias("contaminated"),
        ).alias(out),
    )


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = SIZE,
) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, columns unchanged."""
    hits = _hits(docs, benchmark, doc_col, text_col, item_col, item_text_col, size)
    k0, k1, digest = (fresh(docs, f"_hit_{x}") for x in ("doc", "text", "key"))
    gone = written(hits.filter(_contaminated(F.col("n_hit"), F.col("n"))).select("key0", "key1").toDF(k0, k1), "contaminated")
    keyed = docs.withColumn(digest, F.xxhash64(docs[text_col]))
    same = keyed[doc_col].eqNullSafe(F.col(k0)) & (F.col(digest) == F.col(k1))
    return keyed.join(sent_if_small(gone), same, "left_anti").drop(digest)
