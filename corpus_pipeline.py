"""A training corpus from raw documents: five operators, one after the other.

``STAGES`` are (name, function) in order; each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next one's ``docs``. All but the last return the
columns of ``documents``. Empty tables give empty results; what each operator does with nulls, empty
texts and repeated rows is said in its module. An executor runs all of them, so each bounds the texts it holds at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.llm import decontaminate, line_dedup, neardup, quality, sentencepiece
from tableferry.llm.arrow import text_reads
from tableferry.llm.queries import tokenizer_file
from tableferry.llm.stored import written
from tableferry.llm.text import fresh

SITE_RATIO = 0.05  # of a source's pages; a usual boilerplate line is on about a tenth of them
ENCODED_AT_ONCE = 250  # texts; a worker splits those of a batch into words together


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    text_reads(spark)
    return quality.keep_good(docs)


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source (on more than ``SITE_RATIO`` of its pages); ``n_chars`` follows the text."""
    text_reads(spark)
    clean = line_dedup.without_boilerplate(docs, host_col="source", ratio=SITE_RATIO)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five words, similarity 0.8)."""
    text_reads(spark)
    return neardup.first_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark passage."""
    text_reads(spark)
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ``ids`` and ``n_tokens``; ``restored`` says whether decoding gives the text back."""
    text_reads(spark)
    name = fresh(docs, "encoded")
    both = sentencepiece.with_round_trip(docs, tokenizer_file("piece_bpe_32k.model"), out=name, at_once=ENCODED_AT_ONCE)
    ids = F.col(name)["ids"]
    return both.select(
        *docs.columns, ids.alias("ids"), F.size(ids).cast("long").alias("n_tokens"), F.col(name)["restored"].alias("restored")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", site_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("sentencepiece", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # groups of near-duplicates and token ids are beyond SQL; tests use brute force
