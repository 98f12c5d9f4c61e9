"""Parquet footers as a table: what the files say of themselves, without reading their data.

``spark.read.format("parquet_footers").load(path)`` has one row for each (file, row group, column chunk).
The driver lists the files; tasks open the footers, some dozens of files each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import work_dir
from ..storage import list_files, open_store, qualified

FILES_PER_TASK = 64
CODEC_NAMES = {"UNKNOWN": "LZ4"}  # the library's name for the older framing of LZ4, the only codec it has no name for
BROADCAST_FILES = 200_000  # one narrow row a file: some tens of MB
SCHEMA = (
    "file string, file_bytes long, row_group int, rows long, column string, codec string, bytes long, "
    "uncompressed_bytes long, nulls long, min string, max string"
)


@dataclass
class SomeFiles(InputPartition):
    files: list[tuple[str, int]]


def _chunks(file: str, size: int) -> Iterator[tuple]:
    store, path = open_store(file)
    with store.open_input_file(path) as source:
        footer = pq.ParquetFile(source).metadata
    for g in range(footer.num_row_groups):
        group = footer.row_group(g)
        for c in range(group.num_columns):
            chunk = group.column(c)
            known = chunk.statistics if chunk.is_stats_set else None
            ends = (str(known.min), str(known.max)) if known is not None and known.has_min_max else (None, None)
            nulls = known.null_count if known is not None and known.has_null_count else None
            yield (
                file, size, g, group.num_rows, chunk.path_in_schema, CODEC_NAMES.get(chunk.compression, chunk.compression),
                chunk.total_compressed_size, chunk.total_uncompressed_size, nulls, *ends,
            )


class FooterReader(DataSourceReader):
    def __init__(self, location: str) -> None:
        self.location = location

    def partitions(self) -> list[SomeFiles]:
        files = list_files(self.location)
        return [SomeFiles(files[at : at + FILES_PER_TASK]) for at in range(0, len(files), FILES_PER_TASK)] or [SomeFiles([])]

    def read(self, partition: SomeFiles) -> Iterator[tuple]:
        for file, size in partition.files:
            yield from _chunks(file, size)


class ParquetFooters(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FooterReader:
        return FooterReader(self.options["path"])


def read_footers(spark: SparkSession, path: str) -> DataFrame:
    """One row per column chunk: rows, codec, sizes, nulls and extremes (as text) of its row group."""
    spark.dataSource.register(ParquetFooters)
    return spark.read.format("parquet_footers").load(qualified(spark, path))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``file, tuples, bytes`` of each Parquet file, from the footers alone. Every file has at least one column;
    a file without row groups has no row here."""
    first = F.row_number().over(Window.partitionBy("file", "row_group").orderBy("column")) == 1
    groups = read_footers(spark, path).withColumn("first", first).filter("first")
    return groups.groupBy("file").agg(F.sum("rows").alias("tuples"), F.max("file_bytes").alias("bytes"))


def in_file_order(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """The table at ``path`` with each row's 0-based position: files by name, rows as they stand in them.

    A file's first position is the sum of the row counts before it, from the footers, and its rows are numbered by
    the scan. Nothing of the table is sorted, shuffled or written, and a repeated task gives the same numbers.
    """
    sizes = file_sizes(spark, path)
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = sizes.select("file", F.coalesce(F.sum("tuples").over(earlier), F.lit(0)).alias("_start"))
    kept = work_dir(spark, "file-starts")
    starts.write.parquet(kept)
    starts = spark.read.schema(starts.schema).parquet(kept)
    if starts.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    table = spark.read.parquet(path)
    shown = F.col("_metadata.file_path")  # written as a URI
    named = F.when(shown.contains("%"), F.url_decode(F.replace(shown, F.lit("+"), F.lit("%2B")))).otherwise(shown)
    rows = table.select("*", named.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    missing = F.raise_error(F.concat(F.lit("no footer was read for "), F.col("_file"))).cast("long")
    position: Column = F.coalesce("_start", missing) + F.col("_row")
    return rows.join(starts, rows["_file"] == starts["file"], "left").select(*table.columns, position.alias(name))
