"""Writers. Each is one Spark write job, with ``write_par`` two: shares for the writers, then their files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import WRITER_CODECS
from ..functions.fixed_text import csv_line
from ..schema import enforce_schema, max_text_row, narrow_numbers, nulls_allowed
from ..session import work_dir
from ..sources.footers import file_sizes
from ..sources.tables import LINE_END


def writer_codec(codec: str, fmt: str = "parquet") -> str:
    """Writer codec for the moved data's codec name.

    ``lzo`` has no Spark writer, and Spark's text writer has no ``zstd``; both are refused by name
    before a job starts.
    """
    usable = sorted(c for c in WRITER_CODECS if fmt != "csv" or c != "zstd")
    if codec not in usable:
        raise ValueError(f"codec {codec!r} cannot be written as {fmt}; choose one of {usable}")
    return WRITER_CODECS[codec]


def rows_per_file(schema: T.StructType, max_bytes: int) -> int:
    """Rows that fit ``max_bytes`` of text however wide they print."""
    rows = max_bytes // max_text_row(schema)
    if rows < 1:
        raise ValueError(f"{max_bytes} bytes cannot hold one row of up to {max_text_row(schema)} bytes")
    return rows


def _spread(df: DataFrame, write_par: int | None) -> DataFrame:
    """Rows in turn to the writers, one partition each, so that no value can overload one; none asked, none spread.

    A file is one task's, and that task reads its share of the table whatever is done. So the shares are written as packed
    columns by all tasks first: a writer reads a third of what the same rows take in a shuffle.
    """
    if not write_par:
        return df
    spark, path = df.sparkSession, work_dir(df.sparkSession, "shares")
    share = F.pmod(F.monotonically_increasing_id(), F.lit(write_par)).cast("int").alias("_share")
    df.select("*", share).write.partitionBy("_share").option("compression", "zstd").parquet(path)
    shares = spark.read.schema(T.StructType([*df.schema.fields]).add("_share", T.IntegerType())).parquet(path)
    each = [shares.filter(F.col("_share") == n).drop("_share").coalesce(1) for n in range(write_par)]
    # Spark zips a union of single partitions into one; the last part has no files and keeps them apart.
    return reduce(DataFrame.union, [*each, shares.filter(F.col("_share") < 0).drop("_share")])


def write_csv_lines(
    df: DataFrame,
    path: str,
    schema: T.StructType,
    write_par: int | None = None,
    codec: str = "nocomp",
    max_file_bytes: int | None = None,
    null_as_empty: bool = False,
) -> None:
    """Fixed CSV text, one file per writer, each at most ``max_file_bytes`` long if given.

    As with the other targets a null or a number out of range fails the job; ``null_as_empty`` writes an empty field for a
    null instead. With a limit on the files' bytes, numbers too wide for the limit to hold fail as well.
    """
    typed = nulls_allowed(df, schema) if null_as_empty else enforce_schema(df, schema)
    if max_file_bytes:
        typed = narrow_numbers(typed, schema)
    writer = _spread(typed, write_par).select(csv_line(schema).alias("value")).write.mode("overwrite")
    writer = writer.option("compression", writer_codec(codec, "csv"))
    if max_file_bytes:
        writer = writer.option("maxRecordsPerFile", rows_per_file(schema, max_file_bytes))
    writer.text(path, lineSep=LINE_END)


def write_parquet_table(
    df: DataFrame,
    path: str,
    schema: T.StructType | None = None,
    write_par: int | None = None,
    codec: str = "snappy",
) -> None:
    """Parquet folder, replaced as a whole; with a schema its types and non-null rule are enforced."""
    typed = enforce_schema(df, schema) if schema else df
    _spread(typed, write_par).write.mode("overwrite").option("compression", writer_codec(codec)).parquet(path)


def copy_files(spark: SparkSession, source: str, target: str, fmt: str, codec: str = "nocomp") -> None:
    """Same-format copy. CSV lines are moved as they are, without parsing a single field."""
    if fmt == "csv":
        lines = spark.read.text(source, lineSep=LINE_END).write.mode("overwrite")
        lines.option("compression", writer_codec(codec, "csv")).text(target, lineSep=LINE_END)
    elif fmt == "parquet":
        df = spark.read.parquet(source)
        df.write.mode("overwrite").option("compression", writer_codec(codec)).parquet(target)
    else:
        raise ValueError(f"no same-format copy for {fmt!r}")


def write_jdbc_table(df: DataFrame, url: str, table: str, write_par: int = 1, batch_size: int = 10_000) -> None:
    """Database target. One writer by default; each further writer is one more connection.

    Rows are dealt anew to the writers: a coalesce would pull the work before it into as few tasks.
    """
    (
        df.repartition(write_par)
        .write.format("jdbc")
        .options(url=url, dbtable=table, batchsize=str(batch_size))
        .mode("append")
        .save()
    )


def file_manifest(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """One row per written file: tuples and payload bytes (text, which is read) or file bytes (Parquet, from the footers)."""
    if fmt == "csv":
        df = spark.read.text(path, lineSep=LINE_END).select("value", F.col("_metadata.file_name").alias("file"))
        size = F.sum(F.octet_length("value") + 1)
        return df.groupBy("file").agg(F.count("*").alias("tuples"), size.cast("bigint").alias("bytes"))
    return file_sizes(spark, path).withColumn("file", F.substring_index("file", "/", -1))
