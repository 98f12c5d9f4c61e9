"""Positions and curves over a total order, without ordering anything in one task.

Rows are range-partitioned, sorted and written to a table in the shared folder, one file per range.
A row's position is its index in the file plus the rows of the files before, so the only rows ordered
in one place are the files' counts, and one hot key is split over as many files as it needs. The
table is what makes the positions safe: range bounds come from a sample, so counting one run of the
sort and numbering another could disagree, and so could a task repeated after a lost executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir


def _numbered(df: DataFrame, order: Sequence[str | Column], partitions: int | None) -> DataFrame:
    """The rows with ``_position`` and ``_total``. Writes the ordered table: one job now."""
    spark = df.sparkSession
    path = work_dir(spark, "ordered")
    # Without a number, adaptive execution may merge small neighbouring ranges before they are written.
    ranges = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    # One file per range, whatever the session says; and should a task still begin another file, files
    # count in the order of (task, file of the task), so positions stay apart.
    ranges.sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).parquet(path)

    def number(pattern: str) -> Column:
        return F.regexp_extract("_metadata.file_name", pattern, 1).cast("int")

    file_number = F.struct(number(r"part-(\d+)").alias("task"), number(r"-c(\d+)\.").alias("file")).alias("_file")
    ordered = spark.read.schema(df.schema).parquet(path)
    sizes = ordered.select(file_number).groupBy("_file").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select(
        "_file",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(everything).alias("_total"),
    )
    rows = ordered.select("*", file_number, F.col("_metadata.row_index").alias("_row"))
    # One row per file, and each task of the write has one: no more than the ranges of the sort.
    placed = rows.join(F.broadcast(starts), "_file")
    return placed.select(*df.columns, (F.col("_start") + F.col("_row")).alias("_position"), "_total")


def with_position(
    df: DataFrame, order: Sequence[str | Column], name: str = "position", partitions: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row in ``order``; ties follow each other in no set order."""
    return _numbered(df, order, partitions).select(*df.columns, F.col("_position").alias(name))


def split_contiguous(df: DataFrame, parts: int, order: Sequence[str], name: str = "part") -> DataFrame:
    """Cut the ordered rows into ``parts`` runs of ``ceil(total / parts)`` rows, the last one short."""
    per_part = F.ceil(F.col("_total") / F.lit(parts))
    part = F.floor(F.col("_position") / per_part).cast("int").alias(name)
    return _numbered(df, order, None).select(*df.columns, F.col("_position").alias("line_no"), part)


def descending_curve(df: DataFrame, value: str, tie_break: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """Positive values from high to low with their 0-based index."""
    return with_position(df.filter(F.col(value) > 0), [F.col(value).desc(), *tie_break], name)
