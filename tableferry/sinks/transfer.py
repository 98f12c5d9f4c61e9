"""The public call: move one table from a source to a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import enforce_schema
from ..sources.arrow_files import read_arrow_files
from ..sources.tables import read_csv_table, read_delimited, read_jdbc_table, read_parquet_table
from ..storage import qualified
from .writers import copy_files, file_manifest, write_csv_lines, write_jdbc_table, write_parquet_table

# Options a transfer accepts, with their defaults.
ENGINE_OPTIONS = {
    "read_par": None,
    "read_partitions": 1,
    "read_column": None,
    "read_lower": None,
    "read_upper": None,
    "write_par": None,
    "codec": "nocomp",
    "skip_ser": False,
    "max_file_bytes": None,
    "table_path": None,
}


def _read(spark: SparkSession, fmt: str, where: str, table: str, schema: T.StructType, opts: dict) -> DataFrame:
    if fmt == "csv":
        return read_csv_table(spark, where, schema)
    if fmt == "delimited":
        return read_delimited(spark, where, schema)
    if fmt == "parquet":
        return read_parquet_table(spark, where, schema)
    if fmt == "arrow":
        return read_arrow_files(spark, where, schema)
    if fmt == "jdbc":
        df = read_jdbc_table(
            spark,
            where,
            table,
            read_par=opts["read_par"],
            column=opts["read_column"],
            lower=opts["read_lower"],
            upper=opts["read_upper"],
            read_partitions=opts["read_partitions"],
        )
        return df.select(*schema.names)
    raise ValueError(f"unknown source format {fmt!r}")


def transfer(
    spark: SparkSession,
    source: tuple[str, str],
    target: tuple[str, str],
    table: str,
    schema: T.StructType,
    **config,
) -> DataFrame:
    """Move ``table`` from ``(format, location)`` to ``(format, location)``; returns the manifest.

    Sources: csv, delimited, parquet, arrow, jdbc. Targets: csv, parquet, jdbc, spark (a saved
    table) or the name of a registered data source. The manifest has one row per written file
    (one row in all for jdbc, spark and plugged-in targets) with its tuples and bytes.
    """
    unknown = set(config) - set(ENGINE_OPTIONS)
    if unknown:
        raise ValueError(f"unknown transfer options {sorted(unknown)}")
    opts = {**ENGINE_OPTIONS, **config}
    (src_fmt, src), (dst_fmt, dst) = source, target

    if opts["skip_ser"] and src_fmt == dst_fmt and src_fmt in ("csv", "parquet"):
        copy_files(spark, src, dst, src_fmt, opts["codec"])
        return _labelled(file_manifest(spark, dst, dst_fmt), table, opts)

    df = _read(spark, src_fmt, src, table, schema, opts)
    if dst_fmt == "csv":
        write_csv_lines(df, dst, schema, opts["write_par"], opts["codec"], opts["max_file_bytes"])
        manifest = file_manifest(spark, dst, "csv")
    elif dst_fmt == "parquet":
        write_parquet_table(df, dst, schema, opts["write_par"], opts["codec"])
        manifest = file_manifest(spark, dst, "parquet")
    else:
        # counted while it is written, so that the manifest tells of the target and not of the source
        written = Observation()
        df = enforce_schema(df, schema).observe(written, F.count(F.lit(1)).alias("tuples"))
        if dst_fmt == "jdbc":
            write_jdbc_table(df, dst, table, opts["write_par"] or 1)
        elif dst_fmt == "spark":
            placed = {"path": opts["table_path"]} if opts["table_path"] else {}
            df.write.mode("overwrite").options(**placed).saveAsTable(dst)
        else:
            df.write.format(dst_fmt).mode("append").save(qualified(spark, dst))
        manifest = spark.createDataFrame(
            [(table, written.get["tuples"], None)], "file string, tuples bigint, bytes bigint"
        )
    return _labelled(manifest, table, opts)


def _labelled(manifest: DataFrame, table: str, opts: dict) -> DataFrame:
    return manifest.select(
        F.lit(table).alias("table"), "file", "tuples", "bytes", F.lit(opts["codec"]).alias("codec")
    )
