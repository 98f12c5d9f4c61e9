"""Secret scan: candidate strings, judged by a random forest that removes false positives.

A candidate is a run of 16 to 512 characters that keys are made of, with a digit or mixed classes in
it. Its features: length, shares and transitions of character classes, entropy, likelihood of its
letter transitions in ordinary words, coverage by dictionary words, whether it is (part of) a path or
address, and its neighbouring words. The dictionary and the letter transitions come from word counts
over all documents.

The forest is Spark's own. It is fitted on labelled findings: a given table, or, without one, findings
whose surroundings settle the case (``label_of``): a quoted or assigned value right after a credential's
name is a secret, one marked as a placeholder or inside an address or path is not, and neither is one
with no credential's name, quote or assignment near it. At most about ``SAMPLE`` findings of each label
are used, by a hash. The model is a bounded number of trees; all else covers all documents.

Defined results: null and empty texts have no candidates; a secret that is repeated is found each time;
repeated rows give repeated findings; without findings of both labels every candidate's probability
is its own label or 0.5; columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import text_batches
from .stored import written
from .text import BLANK

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=\-]{16,512}(?![A-Za-z0-9_+/=\-])")
CREDENTIAL = re.compile(r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)")
PLACEHOLDER = re.compile(r"(?i)(example|sample|dummy|placeholder|changeme|your.?key|x{6}|0{12}|test.?only)")
ASSIGNED = re.compile(r"[\w.\-]*\s*(?:=>|:=|=|:)\s*[\"'`]?$")
ADDRESS = re.compile(r"(?:https?:/|www\.|[\w.]/)$")
FEATURES = (
    "length", "digits", "upper", "lower", "symbols", "changes", "entropy", "transitions", "coverage",
    "in_path", "separators", "credential_near", "placeholder", "assigned", "quoted",
)
DICTIONARY = 20_000
SAMPLE = 10_000
TREES, DEPTH, SEED = 30, 6, 11
BEFORE, AFTER = 48, 24  # characters of surroundings that are looked at


def dictionary(docs: DataFrame, text_col: str = "text") -> list[tuple[str, int]]:
    """The most frequent words of four to sixteen letters, with their counts, over all documents."""
    words = docs.select(F.explode(F.split(F.lower(docs[text_col]), BLANK)).alias("word")).filter(
        F.length("word").between(4, 16) & ~F.col("word").rlike(r"[^\p{L}]")
    )
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(DICTIONARY)
    return [(r["word"], r["n"]) for r in top.collect()]  # bounded by DICTIONARY


def transitions(words: list[tuple[str, int]]) -> dict[str, float]:
    """Log-probability of a letter after another in ordinary words (add-one smoothing)."""
    pairs, firsts = Counter(), Counter()
    for word, n in words:
        for a, b in zip(word, word[1:]):
            pairs[a + b] += n
            firsts[a] += n
    letters = len(firsts) + 1
    return {ab: math.log((n + 1) / (firsts[ab[0]] + letters)) for ab, n in pairs.items()}


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if "A" <= c <= "Z" else 2 if "a" <= c <= "z" else 3


def candidates(text: str) -> Iterator[tuple[int, int]]:
    for found in CANDIDATE.finditer(text):
        value = found.group()
        kinds = {_kind(c) for c in value}
        if 0 in kinds or len(kinds) > 2 or (3 in kinds and len(kinds) > 1):
            yield found.start(), found.end()


def coverage(value: str, words: frozenset[str]) -> float:
    """Share of the characters inside dictionary words, longest first from the left."""
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        size = next((k for k in range(min(16, len(low) - at), 3, -1) if low[at : at + k] in words), 0)
        covered += size
        at += size or 1
    return covered / len(low)


def surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - BEFORE) : start], text[end : end + AFTER]


def features(text: str, start: int, end: int, words: frozenset[str], chain: dict[str, float]) -> list[float]:
    value = text[start:end]
    before, after = surroundings(text, start, end)
    n = len(value)
    kinds = [_kind(c) for c in value]
    letters = value.lower()
    rare = [chain.get(ab, -12.0) for ab in map("".join, zip(letters, letters[1:])) if ab.isalpha()]
    near = before[-32:]
    return [
        float(n), *(kinds.count(k) / n for k in range(4)), sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        -sum(k / n * math.log2(k / n) for k in Counter(value).values()),
        sum(rare) / len(rare) if rare else -12.0, coverage(value, words),
        float(bool(ADDRESS.search(before))), sum(c in "/-_=" for c in value) / n,
        float(bool(CREDENTIAL.search(near))), float(bool(PLACEHOLDER.search(value))),
        float(bool(ASSIGNED.search(before))), float(before[-1:] in "\"'`" and before[-1:] == after[:1] != ""),
    ]


def label_of(x: list[float]) -> int | None:
    """1 or 0 where the surroundings settle the case, else none."""
    own = dict(zip(FEATURES, x))
    if own["placeholder"] or own["in_path"]:
        return 0
    if own["credential_near"] and (own["assigned"] or own["quoted"]):
        return 1
    return None if own["credential_near"] or own["assigned"] or own["quoted"] else 0


def _findings(known: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chain = frozenset(w for w, _ in known), transitions(known)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc"), batch.column("text").to_pylist()):
                for start, end in candidates(text or ""):
                    x = features(text, start, end, words, chain)
                    rows.append((doc, start, end, x, label_of(x)))
            doc, start, end, x, label = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d.as_py() for d in doc], batch.column("doc").type), pa.array(start, pa.int32()),
                    pa.array(end, pa.int32()), pa.array(x, pa.list_(pa.float64())), pa.array(label, pa.int32()),
                ],
                ["doc", "start", "end", "features", "label"],
            )

    return run


def findings(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, start, end, features, label`` of every candidate; spans are code points."""
    text_batches(docs.sparkSession)
    known = dictionary(docs, text_col)
    kind = docs.schema[doc_col].dataType.simpleString()
    own = docs.select(docs[doc_col].alias("doc"), docs[text_col].alias("text"))
    return own.mapInArrow(
        _findings(known), f"doc {kind}, start int, end int, features array<double>, label int"
    )


def forest(labelled: DataFrame):
    """A forest on a bounded sample of findings (``features, label``); none without both labels."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    share = F.when(F.col("label") == 1, SAMPLE / max(counts[1], SAMPLE)).otherwise(SAMPLE / max(counts[0], SAMPLE))
    place = F.pmod(F.xxhash64(*labelled.columns), F.lit(1_000_000))
    train = labelled.filter(place < share * 1_000_000).select(
        array_to_vector("features").alias("x"), F.col("label").cast("double").alias("label")
    )
    trees = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return trees.fit(train.coalesce(8))


def scanned(
    docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None
) -> DataFrame:
    """``doc, start, end, label, probability`` of every candidate."""
    found = written(findings(docs, doc_col, text_col), "findings")
    model = forest(labelled if labelled is not None else found.filter(F.col("label").isNotNull()))
    if model is None:
        return found.select("doc", "start", "end", "label", F.coalesce(F.col("label").cast("double"), F.lit(0.5)).alias("probability"))
    judged = model.transform(found.withColumn("x", array_to_vector("features")))
    return judged.select("doc", "start", "end", "label", vector_to_array("probability")[1].alias("probability"))
