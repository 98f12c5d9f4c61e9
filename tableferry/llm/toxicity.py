"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a probability of its own (logistic in its distinct
words), and the document is toxic if any sentence is: P = 1 - prod(1 - p_s), the noisy-or. Only
document labels are given; the gradient of the document's likelihood reaches sentence s with the
weight p_s (times (1 - P) / P in toxic documents), so the sentences that explain a label are found
in training, and a scored document names its offending sentences.

The classifier is fitted in the driver on a bounded sample: at most about ``SAMPLE_DOCS`` labelled
documents of each class, of at most ``SAMPLE_WORDS`` words each, taken by a hash of their id. Each
weighs 1 / its class's sampling share in the likelihood, so the classes count as they do in the whole
table, whatever its size. The classifier is a table of word weights (at most ``VOCABULARY``), sent to the tasks. Scoring reads every document
once, without a shuffle.

Defined results: null and empty texts have no sentences and score 0; several labels of one document
count as their largest, null labels as none; without labels of both classes every score is 0;
repeated rows give equal rows; other columns are passed on untouched. Only the text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import text_batches
from .stored import written
from .text import fresh

SAMPLE_DOCS = 4_000
SAMPLE_WORDS = 5_000
VOCABULARY = 50_000
LEAST_COUNT = 5  # documents of the sample that must have a word
EPOCHS = 300
STEP = 0.1
DECAY = 5e-5
LEAK = -6.0  # logit of a sentence without known words at the start

SENTENCE_END = re.compile(r"[.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = (5, 7)  # beginnings of a word that are features too, written "abc-"
RESULT = "struct<score:double,sentences:array<struct<sentence:int,score:double>>>"


def sentences(text: str | None) -> list[list[str]]:
    """Distinct lower-cased words, and beginnings of words, of each sentence that has any."""
    out = []
    for part in SENTENCE_END.split((text or "").lower()):
        if words := set(TOKEN.findall(part)):
            out.append([*words, *{w[:k] + "-" for w in words for k in PREFIXES if len(w) > k}])
    return out


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    leak: float


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [sorted({w for s in sentences(text) for w in s}) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string()))], ["words"])


def coded(bag: list[list[str]], places: dict[str, int]) -> tuple[list[int], list[int]]:
    """Numbers of a bag's known words, and how many each sentence has."""
    own = [[places[w] for w in s if w in places] for s in bag]
    return [x for s in own for x in s], [len(s) for s in own]


def _bags(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {w: i for i, w in enumerate(names)}
        for batch in batches:
            own = [coded(sentences(text), places) for text in batch.column("text").to_pylist()]
            words, sizes = zip(*own) if own else ([], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label"), batch.column("weight"),
                    pa.array(words, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32())),
                ],
                ["label", "weight", "words", "sizes"],
            )

    return run


def sample(docs: DataFrame, labels: DataFrame, doc_col: str, text_col: str, label_col: str) -> tuple[list[str], pa.Table]:
    """The vocabulary, and the bags of a bounded number of labelled documents as numbers of its words."""
    own = labels.groupBy(labels[doc_col].alias("doc")).agg(F.max(labels[label_col].cast("int")).alias("label"))
    own = own.filter(F.col("label").isNotNull() & F.col("doc").isNotNull())
    sizes = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    weight = F.lit(1.0)  # 1 / the sampling share
    for label, n in sizes.items():
        weight = F.when(F.col("label") == label, F.lit(max(n, SAMPLE_DOCS) / SAMPLE_DOCS)).otherwise(weight)
    own = own.withColumn("weight", weight)
    picked = written(own.filter(F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) * F.col("weight") < 1_000_000), "labelled")
    texts = docs.select(docs[doc_col].alias("doc"), docs[text_col].alias("text"))
    texts = texts.filter(F.length("text") <= 8 * SAMPLE_WORDS)
    # 2 * SAMPLE_DOCS rows, more or less, at any size of the tables
    bags = written(texts.join(F.broadcast(picked), "doc").select("label", "weight", "text"), "labelled-texts")
    words = bags.mapInArrow(_features, "words array<string>").select(F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    names = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]
    return names, bags.mapInArrow(_bags(names), "label int, weight double, words array<int>, sizes array<int>").toArrow()


def fit(names: list[str], bags: pa.Table) -> Model:
    """Gradient ascent (Adam) on the documents' likelihood, each with its ``weight`` (1 if there is none)."""
    label = bags.column("label").to_numpy().astype(np.float64)
    if len(label) == 0 or label.min() == label.max():
        return Model({}, LEAK)
    weight = bags.column("weight").to_numpy() if "weight" in bags.column_names else np.ones(len(label))
    weight = weight / weight.sum()
    words, sizes = bags.column("words").combine_chunks(), bags.column("sizes").combine_chunks()
    word, sentence_size = words.flatten().to_numpy(), sizes.flatten().to_numpy()
    sentence_doc = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(sizes.offsets.to_numpy()))
    row = np.repeat(np.arange(len(sentence_size), dtype=np.int32), sentence_size)
    n_words, n_rows, n_docs = len(names), len(sentence_size), len(label)
    theta = np.append(np.zeros(n_words), LEAK)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, EPOCHS + 1):
        z = np.bincount(row, theta[word], n_rows) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(sentence_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n_docs)
        toxic = -np.expm1(clean)
        pull = np.where(label > 0, np.exp(clean) / np.maximum(toxic, 1e-9), -1.0) * weight
        g = p * pull[sentence_doc]
        grad = np.append(np.bincount(word, g[row], n_words), g.sum())
        grad[:-1] -= DECAY * np.sign(theta[:-1])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta += STEP * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-6)
    return Model({w: float(x) for w, x in zip(names, theta[:-1]) if abs(x) > 0.05}, float(theta[-1]))


def score(text: str | None, model: Model, least: float = 0.1) -> dict:
    """The document's probability and its offending sentences (place among sentences with words).

    A sentence counts by how far it lies above one without known words, so that length alone
    makes no document toxic.
    """
    floor = 1 / (1 + np.exp(-model.leak))
    clean, found, get = 1.0, [], model.words.get
    for at, words in enumerate(sentences(text)):
        z = sum([w for w in map(get, words) if w])
        if z <= 0:
            continue
        p = (1 / (1 + np.exp(-(z + model.leak))) - floor) / (1 - floor)
        clean *= 1 - p
        if p >= least:
            found.append({"sentence": at, "score": float(p)})
    return {"score": float(min(1.0, max(0.0, 1 - clean))), "sentences": found}


def scores(text: Column, model: Model) -> Column:
    kind = pa.struct(
        [("score", pa.float64()), ("sentences", pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())])))]
    )

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([score(x, model) for x in batch.to_pylist()], kind)

    return run(text)


def scanned(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` and a struct of ``score`` and offending ``sentences``."""
    text_batches(docs.sparkSession)
    return docs.withColumn(fresh(docs, out), scores(docs[text_col], model))


def trained(
    docs: DataFrame, labels: DataFrame, doc_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    text_batches(docs.sparkSession)
    return fit(*sample(docs, labels, doc_col, text_col, label_col))
