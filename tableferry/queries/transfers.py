"""Sources, sinks, blocks and audit, each run over the whole lineitem table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_text import csv_line, pad_bytes
from ..operators import audit, blocks, ordering, summarize
from ..schema import cut_to_schema, enforce_schema, rows_per_block, schema_from_json, struct_of
from ..session import work_dir
from ..sinks import (
    BlockFileSink,
    append_transfer_record,
    copy_files,
    file_manifest,
    read_transfer_log,
    rows_per_file,
    transfer,
    write_csv_lines,
    write_parquet_table,
)
from ..sources import (
    CLIENT_TIMINGS,
    GENERAL_STATS,
    read_arrow_files,
    read_csv_table,
    read_delimited,
    read_footers,
    read_parquet_table,
    read_run_log,
    read_timing_files,
    split_text_file,
)
from ..storage import qualified
from . import derived as d
from .registry import query

ALL = "SELECT * FROM xfer"
BLOCK_KIB = 64
BLOCK_ROWS = rows_per_block(d.LINEITEM, BLOCK_KIB)
ORDER_SQL = ", ".join(d.LINEITEM_ORDER)
NUMBERED_SQL = (
    f"{d.LINES_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) - 1 AS pos FROM lines)"
)
WITH_TABLE = f"WITH {d.LINEITEM_SQL} "
WITH_LINES = f"WITH {d.LINES_SQL} "


def _lines(df: DataFrame) -> DataFrame:
    return df.select(csv_line(d.LINEITEM).alias("line"))


def _csv_copy(spark: SparkSession, sf_dir: str, **options) -> str:
    path = work_dir(spark, "lineitem-csv")
    write_csv_lines(d.lineitem(spark, sf_dir), path, d.LINEITEM, **options)
    return path


def _parquet_copy(spark: SparkSession, sf_dir: str) -> str:
    path = work_dir(spark, "lineitem-parquet")
    write_parquet_table(d.lineitem(spark, sf_dir), path, d.LINEITEM)
    return path


def _arrow_copy(spark: SparkSession, sf_dir: str) -> str:
    path = work_dir(spark, "lineitem-arrow")
    spark.dataSource.register(BlockFileSink)
    d.lineitem(spark, sf_dir).write.format("block_files").mode("append").save(qualified(spark, path))
    return path


# --- sources ----------------------------------------------------------------------------------


@query("src3_csv_table", WITH_TABLE + ALL)
def csv_table(spark, sf_dir):
    return read_csv_table(spark, _csv_copy(spark, sf_dir), d.LINEITEM)


@query("src4_parquet_columns", WITH_TABLE + "SELECT l_orderkey, l_quantity, l_shipdate FROM xfer")
def parquet_columns(spark, sf_dir):
    path = _parquet_copy(spark, sf_dir)
    names = ("l_orderkey", "l_quantity", "l_shipdate")
    return read_parquet_table(spark, path, struct_of([(f.name, f.metadata["type"], f.metadata["size"])
                                                      for f in d.LINEITEM.fields if f.name in names]))


@query("src5_delimited_text", WITH_TABLE + ALL)
def delimited_text(spark, sf_dir):
    path = work_dir(spark, "lineitem-delimited")
    df = d.lineitem(spark, sf_dir)
    df.select(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])).write.text(path)
    return read_delimited(spark, path, d.LINEITEM, "|")


@query("src7_arrow_blocks", WITH_TABLE + ALL)
def arrow_blocks(spark, sf_dir):
    return read_arrow_files(spark, _arrow_copy(spark, sf_dir), d.LINEITEM)


@query("src8_timing_files", f"WITH {d.SERVER_SQL} SELECT * FROM server_timings")
def timing_files(spark, sf_dir):
    path = work_dir(spark, "server-timings")
    d.server_timings(spark, sf_dir).write.option("header", True).csv(path)
    return read_timing_files(spark, path, "server", "*.csv").drop("source_file")


_KNOWN_STATS = [c for c in GENERAL_STATS.names if c in d.RUN_STATS]


@query(
    "src9_run_log_scan",
    f"WITH {d.RUN_STATS_SQL} SELECT "
    + ", ".join(f'"{c}"' if c in _KNOWN_STATS else f'NULL AS "{c}"' for c in GENERAL_STATS.names)
    + " FROM run_stats",
)
def run_log_scan(spark, sf_dir):
    """A general-stats file with all 32 columns; those the tables here say nothing of are empty."""
    path = work_dir(spark, "general-stats")
    stats = d.run_stats(spark, sf_dir)
    full = stats.select(
        *[
            (F.col(f.name) if f.name in d.RUN_STATS else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in GENERAL_STATS.fields
        ]
    )
    full.write.option("header", True).csv(path)
    return read_run_log(spark, path, GENERAL_STATS)


PARTS_SQL = (
    f"WITH {NUMBERED_SQL}, cut AS (SELECT *, CAST(pos // CAST(ceil((SELECT count(*) FROM lines) / 7.0) AS BIGINT) "
    "AS INTEGER) AS part FROM numbered) SELECT part, count(*) AS \"lines\", min(pos) AS first_line, "
    "max(pos) AS last_line, min(line) AS lowest, max(line) AS highest FROM cut GROUP BY part"
)


def _runs(numbered: DataFrame, line) -> DataFrame:
    return numbered.groupBy("part").agg(
        F.count("*").alias("lines"),
        F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"),
        F.min(line).alias("lowest"),
        F.max(line).alias("highest"),
    )


@query("src10_contiguous_parts", PARTS_SQL)
def contiguous_parts(spark, sf_dir):
    """A table without an order of its own, in a wanted one."""
    return _runs(ordering.split_contiguous(d.lineitem(spark, sf_dir), 7, d.LINEITEM_ORDER), csv_line(d.LINEITEM))


@query("src10_text_file_parts", PARTS_SQL)
def text_file_parts(spark, sf_dir):
    """Text files as they are: written in order here, so that the checking engine knows it."""
    path = work_dir(spark, "ordered-lines")
    _lines(d.lineitem(spark, sf_dir).orderBy(*d.LINEITEM_ORDER)).write.text(path, lineSep="\n")
    return _runs(split_text_file(spark, path, 7, range_bytes=256 << 10), F.col("value"))


# --- sinks ------------------------------------------------------------------------------------


@query("snk1_fixed_csv_line", WITH_LINES + "SELECT line FROM lines")
def fixed_csv_line(spark, sf_dir):
    return _lines(enforce_schema(d.lineitem(spark, sf_dir), d.LINEITEM))


@query(
    "snk2_parallel_csv",
    WITH_LINES + 'SELECT CAST(4 AS BIGINT) AS files, count(*) AS tuples, '
    "CAST(sum(length(line) + 1) AS BIGINT) AS bytes FROM lines",
)
def parallel_csv(spark, sf_dir):
    manifest = file_manifest(spark, _csv_copy(spark, sf_dir, write_par=4), "csv")
    return manifest.agg(
        F.count("*").alias("files"), F.sum("tuples").alias("tuples"), F.sum("bytes").alias("bytes")
    )


@query("snk3_parquet_to_csv", WITH_LINES + "SELECT line FROM lines")
def parquet_to_csv(spark, sf_dir):
    target = work_dir(spark, "csv")
    transfer(spark, ("parquet", _parquet_copy(spark, sf_dir)), ("csv", target), "lineitem", d.LINEITEM)
    return spark.read.text(target).withColumnRenamed("value", "line")


@query("snk4_arrow_to_csv", WITH_LINES + "SELECT line FROM lines")
def arrow_to_csv(spark, sf_dir):
    target = work_dir(spark, "csv")
    transfer(spark, ("arrow", _arrow_copy(spark, sf_dir)), ("csv", target), "lineitem", d.LINEITEM)
    return spark.read.text(target).withColumnRenamed("value", "line")


@query("snk5_column_blocks_to_csv", WITH_LINES + "SELECT line FROM lines")
def column_blocks_to_csv(spark, sf_dir):
    names = d.LINEITEM.names
    cut = _file_cut(spark, sf_dir)
    return _lines(blocks.to_row_blocks(blocks.to_column_blocks(cut, names), names))


@query("snk6_parquet_sink", WITH_TABLE + ALL)
def parquet_sink(spark, sf_dir):
    return spark.read.parquet(_parquet_copy(spark, sf_dir))


@query("snk7_enforced_schema", WITH_TABLE + ALL)
def enforced_schema(spark, sf_dir):
    return enforce_schema(d.lineitem(spark, sf_dir), d.LINEITEM)


@query("snk8_arrow_to_parquet", WITH_TABLE + ALL)
def arrow_to_parquet(spark, sf_dir):
    target = work_dir(spark, "parquet")
    source = _arrow_copy(spark, sf_dir)
    transfer(spark, ("arrow", source), ("parquet", target), "lineitem", d.LINEITEM, codec="snappy")
    return spark.read.parquet(target)


@query("snk9_column_blocks_to_parquet", WITH_TABLE + ALL)
def column_blocks_to_parquet(spark, sf_dir):
    names = d.LINEITEM.names
    cut = _file_cut(spark, sf_dir)
    rows = blocks.to_row_blocks(blocks.to_column_blocks(cut, names), names).select(*names)
    path = work_dir(spark, "parquet")
    write_parquet_table(rows, path, d.LINEITEM)
    return spark.read.parquet(path)


@query("snk10_same_format_copy", WITH_LINES + "SELECT line FROM lines")
def same_format_copy(spark, sf_dir):
    target = work_dir(spark, "copy")
    copy_files(spark, _csv_copy(spark, sf_dir), target, "csv")
    return spark.read.text(target).withColumnRenamed("value", "line")


@query("snk12_saved_table", WITH_TABLE + ALL)
def saved_table(spark, sf_dir):
    path = work_dir(spark, "table")
    name = "lineitem_" + path.rsplit("-", 1)[1]
    transfer(spark, ("parquet", _parquet_copy(spark, sf_dir)), ("spark", name), "lineitem", d.LINEITEM, table_path=path)
    return spark.table(name)


# What the footers call the codecs that were asked for.
FOOTER_CODECS = {"nocomp": "UNCOMPRESSED", "zstd": "ZSTD", "snappy": "SNAPPY", "lz4": "LZ4", "zlib": "GZIP"}


@query(
    "snk13_codecs",
    "SELECT codec, found, n.rows AS tuples, c.n AS columns, n.low AS lowest_key, n.high AS highest_key FROM (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in FOOTER_CODECS.items())
    + ") t(codec, found), (SELECT count(*) AS rows, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem) n, "
    f"(SELECT {len(d.LINEITEM.names)}::BIGINT AS n) c",
)
def codecs(spark, sf_dir):
    """The codec, rows and key range that the written files' own footers name."""
    source = _parquet_copy(spark, sf_dir)
    parts = None
    for codec in FOOTER_CODECS:
        target = work_dir(spark, codec)
        transfer(spark, ("parquet", source), ("parquet", target), "lineitem", d.LINEITEM, codec=codec)
        chunks = read_footers(spark, target).withColumn("asked", F.lit(codec))
        parts = chunks if parts is None else parts.unionByName(chunks)
    key = F.col("column") == "l_orderkey"
    return parts.groupBy(F.col("asked").alias("codec"), F.col("codec").alias("found")).agg(
        F.sum(F.when(key, F.col("rows"))).alias("tuples"),
        F.count_distinct("column").alias("columns"),
        F.min(F.when(key, F.col("min").cast("bigint"))).alias("lowest_key"),
        F.max(F.when(key, F.col("max").cast("bigint"))).alias("highest_key"),
    )


@query(
    "snk14_transfer_record",
    f"WITH {d.CLIENT_SQL} SELECT *, strftime(to_timestamp(transfer_id) AT TIME ZONE 'UTC', '%Y-%m-%d') AS transfer_day "
    "FROM client_timings",
)
def transfer_record(spark, sf_dir):
    path = work_dir(spark, "transfer-log")
    record = d.client_timings(spark, sf_dir)
    for part in ("transfer_id % 2 = 0", "transfer_id % 2 = 1", "transfer_id % 2 = 0"):  # the last is a repeated call
        append_transfer_record(record.filter(part), path)
    log = read_transfer_log(spark, path)
    return log.select(*CLIENT_TIMINGS.names, F.date_format("transfer_day", "yyyy-MM-dd").alias("transfer_day"))


@query(
    "snk15_transfer_manifest",
    WITH_LINES + "SELECT 'lineitem' AS \"table\", count(*) AS tuples, CAST(sum(length(line) + 1) AS BIGINT) AS bytes, "
    "'nocomp' AS codec FROM lines",
)
def transfer_manifest(spark, sf_dir):
    source = _parquet_copy(spark, sf_dir)
    manifest = transfer(
        spark, ("parquet", source), ("csv", work_dir(spark, "csv")), "lineitem", d.LINEITEM, write_par=3
    )
    return manifest.groupBy("table", "codec").agg(
        F.sum("tuples").alias("tuples"), F.sum("bytes").alias("bytes")
    ).select("table", "tuples", "bytes", "codec")


FILE_BYTES = 1 << 20


@query(
    "snk16_file_size_limit",
    "SELECT count(*) AS tuples, true AS within_bytes, true AS within_rows FROM lineitem",
)
def file_size_limit(spark, sf_dir):
    path = _csv_copy(spark, sf_dir, max_file_bytes=FILE_BYTES)
    return file_manifest(spark, path, "csv").agg(
        F.sum("tuples").alias("tuples"),
        (F.max("bytes") <= FILE_BYTES).alias("within_bytes"),
        (F.max("tuples") <= rows_per_file(d.LINEITEM, FILE_BYTES)).alias("within_rows"),
    )


@query("udf1_plugin_sink", WITH_TABLE + ALL)
def plugin_sink(spark, sf_dir):
    """The target is named like any other format once its class is registered."""
    target = work_dir(spark, "plugin")
    spark.dataSource.register(BlockFileSink)
    transfer(spark, ("parquet", _parquet_copy(spark, sf_dir)), ("block_files", target), "lineitem", d.LINEITEM)
    return read_arrow_files(spark, target, d.LINEITEM)


@query(
    "fn12_fixed_width_text",
    "SELECT c_custkey, rpad(substr(c_mktsegment, 1, 8), 8, '~') AS segment, rpad(substr(c_name, 1, 30), 30, '~') "
    "AS name FROM customer",
)
def fixed_width_text(spark, sf_dir):
    """NUL padding is shown as ~ so that results stay printable."""
    df = d.table(spark, sf_dir, "customer")

    def shown(name: str, size: int):
        return F.translate(pad_bytes(F.col(name), size), "\x00", "~")

    return df.select("c_custkey", shown("c_mktsegment", 8).alias("segment"), shown("c_name", 30).alias("name"))


# --- blocks and audit -------------------------------------------------------------------------

CUT_SQL = f", cut AS (SELECT *, pos // {BLOCK_ROWS} AS block, pos % {BLOCK_ROWS} AS slot FROM numbered) "
BLOCKS_SQL = f"WITH {NUMBERED_SQL}{CUT_SQL}"
# Rows as they stand in the file, which is how the checking engine numbers them without an order.
FILE_SQL = f"{d.LINES_SQL}, numbered AS (SELECT *, row_number() OVER () - 1 AS pos FROM lines)"
ASSIGNED_SQL = (
    "SELECT block, CAST(block % 4 AS INTEGER) AS writer, count(*) AS tuples, min(slot) AS first_slot, "
    "max(slot) AS last_slot, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM cut GROUP BY block"
)


def _cut(spark, sf_dir, writers: int = 1) -> DataFrame:
    """Blocks of the whole table in the order of all its columns, however the files hold it."""
    return blocks.assign_blocks(d.lineitem(spark, sf_dir), BLOCK_ROWS, d.LINEITEM_ORDER, writers)


def _file_cut(spark, sf_dir, writers: int = 1) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    cut = blocks.file_blocks(spark, f"{sf_dir}/lineitem.parquet", BLOCK_ROWS, writers)
    return d.as_transfer_table(cut, "block", "slot", "writer")


def _per_block(cut: DataFrame) -> DataFrame:
    return cut.groupBy("block", "writer").agg(
        F.count("*").alias("tuples"),
        F.min("slot").alias("first_slot"),
        F.max("slot").alias("last_slot"),
        F.sum("l_orderkey").alias("key_sum"),
    )


@query("blk1_assign_blocks", BLOCKS_SQL + ASSIGNED_SQL)
def assigned_blocks(spark, sf_dir):
    return _per_block(_cut(spark, sf_dir, 4))


@query("blk1_file_blocks", f"WITH {FILE_SQL}{CUT_SQL}" + ASSIGNED_SQL)
def file_blocks(spark, sf_dir):
    """Blocks of the rows as they stand in the files, without a sort."""
    return _per_block(_file_cut(spark, sf_dir, 4))


@query(
    "blk2_column_blocks",
    BLOCKS_SQL + "SELECT block, CAST(count(*) AS INTEGER) AS tuples, string_agg(l_orderkey, ',' ORDER BY slot) "
    "AS keys, string_agg(l_shipdate, ',' ORDER BY slot) AS dates FROM cut GROUP BY block",
)
def column_blocks(spark, sf_dir):
    packed = blocks.to_column_blocks(_cut(spark, sf_dir), d.LINEITEM.names)
    return packed.select(
        "block",
        "tuples",
        F.array_join(F.col("l_orderkey").cast("array<string>"), ",").alias("keys"),
        F.array_join("l_shipdate", ",").alias("dates"),
    )


@query(
    "blk3_row_blocks",
    BLOCKS_SQL + f"SELECT block, CAST(slot AS INTEGER) AS slot, {ORDER_SQL} FROM cut",
)
def row_blocks(spark, sf_dir):
    names = d.LINEITEM.names
    return blocks.to_row_blocks(blocks.to_column_blocks(_cut(spark, sf_dir), names), names)


@query(
    "aud1_block_manifest",
    BLOCKS_SQL + "SELECT block, count(*) AS tuples, CAST(sum(length(line) + 1) AS BIGINT) AS bytes, 1 AS layout, "
    "0 AS codec FROM cut GROUP BY block",
)
def block_manifest(spark, sf_dir):
    return audit.block_manifest(_cut(spark, sf_dir), csv_line(d.LINEITEM), 1, 0)


@query(
    "aud2_manifest_violations",
    BLOCKS_SQL + ", manifest AS (SELECT block, count(*) AS tuples, CAST(sum(length(line) + 1) AS BIGINT) AS bytes, "
    "1 AS layout, CAST(block % 9 AS INTEGER) AS codec FROM cut GROUP BY block), judged AS (SELECT *, "
    f"concat_ws(',', CASE WHEN tuples > {BLOCK_ROWS - 1} THEN 'tuples' END, CASE WHEN bytes > 63000 THEN 'bytes' END, "
    "CASE WHEN codec > 6 THEN 'codec' END) AS reasons FROM manifest) SELECT * FROM judged WHERE reasons <> ''",
)
def manifest_violations(spark, sf_dir):
    manifest = audit.block_manifest(_cut(spark, sf_dir), csv_line(d.LINEITEM), 1, 0)
    suspect = manifest.withColumn("codec", (F.col("block") % 9).cast("int"))
    return audit.manifest_violations(suspect, BLOCK_ROWS - 1, 63000)


@query(
    "aud3_byte_checksum",
    WITH_LINES + ", bytes AS (SELECT l_returnflag, l_linestatus, unnest(string_split(line, '')) AS c FROM lines) "
    "SELECT l_returnflag, l_linestatus, CAST(bit_xor(ascii(c)) AS INTEGER) AS checksum FROM bytes GROUP BY 1, 2",
)
def byte_checksum(spark, sf_dir):
    line = csv_line(d.LINEITEM)
    return d.lineitem(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(
        audit.byte_checksum(line).alias("checksum")
    )


def _crc_table() -> str:
    """CRC-32 by byte, made from its polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return f"[{', '.join(map(str, out))}]::BIGINT[]"


@query(
    "aud4_crc32",
    WITH_LINES + f", t AS (SELECT {_crc_table()} AS crcs), sums AS (SELECT l_returnflag, xor(list_reduce(list_concat("
    "[4294967295::BIGINT], list_transform(string_split(line, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: "
    "xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS crc FROM lines, t) "
    "SELECT l_returnflag, count(*) AS tuples, bit_xor(crc) AS crc_xor, CAST(sum(crc) AS BIGINT) AS crc_sum "
    "FROM sums GROUP BY 1",
)
def crc32(spark, sf_dir):
    sums = audit.crc_checksums(d.lineitem(spark, sf_dir), csv_line(d.LINEITEM), ["l_returnflag"])
    return sums.withColumn("crc_sum", F.col("crc_sum").cast("bigint"))


def _verify_sql() -> str:
    parts = []
    changed = "l_discount + CASE WHEN l_orderkey % 100 = 1 THEN 0.5 ELSE 0 END"
    for copy in ("exact", "changed"):
        for c in d.LINEITEM.names:
            other = changed if copy == "changed" and c == "l_discount" else c
            same = f"sum(hash(CAST({c} AS VARCHAR))) = sum(hash(CAST({other} AS VARCHAR))) AND max({c}) = max({other})"
            rows = "true" if copy == "exact" else f"sum(l_discount) = sum({changed})"
            parts.append(
                f"SELECT '{copy}' AS copy, '{c}' AS \"column\", count(*) AS rows_a, count(*) AS rows_b, "
                f"{rows} AS same_rows, {same} AS same_values, ({rows}) AND {same} AS accepted FROM xfer"
            )
    return WITH_TABLE + " UNION ALL ".join(parts)


@query("aud5_verify_copy", _verify_sql())
def verified_copies(spark, sf_dir):
    original = d.lineitem(spark, sf_dir)
    copy = read_csv_table(spark, _csv_copy(spark, sf_dir), d.LINEITEM)
    changed = original.withColumn(
        "l_discount", F.col("l_discount") + F.when(F.col("l_orderkey") % 100 == 1, 0.5).otherwise(0.0)
    )
    return audit.verify_copies(original, {"exact": copy, "changed": changed})


@query(
    "aud5_row_differences",
    WITH_TABLE + ", a AS (SELECT l_orderkey, l_linenumber FROM xfer WHERE l_quantity > 5), "
    "b AS (SELECT l_orderkey, l_linenumber FROM xfer WHERE l_quantity <= 45), "
    "s AS (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b) "
    "SELECT l_orderkey, l_linenumber, CAST(sum(n) AS BIGINT) AS surplus FROM s GROUP BY 1, 2 HAVING sum(n) <> 0",
)
def row_differences(spark, sf_dir):
    df = d.lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity")
    a = df.filter("l_quantity > 5").drop("l_quantity")
    b = df.filter("l_quantity <= 45").drop("l_quantity")
    return audit.row_differences(a, b)


# --- in-flight analytics and projections ------------------------------------------------------


@query(
    "agg1_first_attribute_stats",
    "SELECT count(*) AS totalcnt, count(l_orderkey) AS cnt, min(l_orderkey) AS \"min\", max(l_orderkey) AS \"max\", "
    "CAST(sum(l_orderkey) AS DOUBLE) AS \"sum\", CAST(sum(l_orderkey) AS DOUBLE) / count(l_orderkey) AS \"avg\" "
    "FROM lineitem",
)
def first_attribute_stats(spark, sf_dir):
    df = summarize.first_attribute_stats(d.table(spark, sf_dir, "lineitem"), "l_orderkey")
    return df.withColumn("sum", F.col("sum").cast("double"))


@query(
    "prj1_keep_columns",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax "
    "FROM lineitem",
)
def keep_columns(spark, sf_dir):
    from ..operators.select import keep_columns as keep

    return keep(d.table(spark, sf_dir, "lineitem"), d.LINEITEM.names[:8])


@query("prj2_drop_columns", WITH_TABLE + "SELECT * EXCLUDE (l_tax, l_shipdate) FROM xfer")
def drop_columns(spark, sf_dir):
    from ..operators.select import drop_columns as drop

    return drop(d.lineitem(spark, sf_dir), ["l_tax", "l_shipdate", "not_there"])


@query(
    "src1_cut_to_schema",
    "SELECT c_custkey, substr(c_name, 1, 12) AS c_name, substr(c_mktsegment, 1, 4) AS c_mktsegment FROM customer",
)
def cut_columns(spark, sf_dir):
    short = struct_of([("c_custkey", "INT", 4), ("c_name", "STRING", 12), ("c_mktsegment", "STRING", 4)])
    return cut_to_schema(d.table(spark, sf_dir, "customer"), short)


_SHORT = [("c_custkey", "INT", 4), ("c_name", "STRING", 12), ("c_mktsegment", "CHAR", 1)]


@query(
    "src1_schema_from_json",
    "SELECT c_custkey, substr(c_name, 1, 12) AS c_name, substr(c_mktsegment, 1, 1) AS c_mktsegment FROM customer",
)
def schema_file(spark, sf_dir):
    """The table in the columns, types and sizes that a schema file names."""
    path = work_dir(spark, "schema")
    text = json.dumps([{"name": n, "type": t, "size": s} for n, t, s in _SHORT])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return enforce_schema(d.table(spark, sf_dir, "customer"), schema_from_json(path, spark))
