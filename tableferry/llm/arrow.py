"""Settings for batches that hold texts: those sent to Python workers and those read from files."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
READ = "spark.sql.parquet.columnarReaderBatchSize"


def text_batches(spark: SparkSession, rows: int = 1_000, size: str = "16m") -> None:
    """Bounds what a Python worker holds at once: so many rows and bytes a batch.

    The bounds are session settings because Spark reads them when the query runs.
    """
    spark.conf.set(ROWS, str(rows))
    spark.conf.set(BYTES, size)


def text_reads(spark: SparkSession, rows: int = 128) -> None:
    """Bounds how many rows of a Parquet file a task holds at once, for the rest of the session; a lower setting stays.

    Spark's usual 4,096 texts fill vectors of tens of MB. Arrays that large make the collector start over
    and over, and it lets the heap grow to its limit, beside the Python workers.
    """
    spark.conf.set(READ, str(min(rows, int(spark.conf.get(READ)))))
