"""Continuous transfers and incremental appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..functions.fixed_text import csv_line
from ..schema import enforce_schema
from ..sources.tables import PLAIN_CSV, filled_text
from .seen import UnseenRows


def new_files(spark: SparkSession, folder: str, schema: T.StructType, fmt: str, per_batch: int | None = None) -> DataFrame:
    """New source files of a folder as a stream; CSV in the fixed format, or Parquet."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if fmt == "csv":
        return filled_text(reader.options(**PLAIN_CSV).csv(folder))
    return reader.format(fmt).load(folder)


def continuous_transfer(rows: DataFrame, schema: T.StructType, fmt: str, path: str, checkpoint: str) -> DataStreamWriter:
    """Stream rows into a CSV or Parquet folder. The file sink's own log makes each file count once."""
    if fmt == "csv":
        out, kind = enforce_schema(rows, schema).select(csv_line(schema).alias("value")), "text"
    elif fmt == "parquet":
        out, kind = enforce_schema(rows, schema), "parquet"
    else:
        raise ValueError(f"unknown target format {fmt!r}")
    return (
        out.writeStream.format(kind)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def append_unseen(rows: DataFrame, id_column: str, path: str, checkpoint: str, schema: T.StructType) -> DataStreamWriter:
    """Append rows whose id (epoch seconds) no earlier batch stored, to the store that ``UnseenRows(...).rows()`` reads."""

    def save(batch: DataFrame, batch_id: int) -> None:
        UnseenRows(batch.sparkSession, path, schema, id_column).append(batch, batch_id)

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
