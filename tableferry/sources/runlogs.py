"""Run logs: CSV files with a header and a known column list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import CLIENT_STAGES, SERVER_STAGES


_KINDS = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType()}


def _struct(text: str) -> T.StructType:
    """Schema from ``name TYPE, ...``; needs no session, so logs are known at import."""
    columns = [c.split() for c in text.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in columns])


def _timings(stages: tuple[str, ...], loads: tuple[str, ...]) -> T.StructType:
    columns = ["transfer_id BIGINT", "total_time DOUBLE"]
    for stage, load in zip(stages, loads):
        for measure in ("wait_time", "proc_time", "throughput", "throughput_pb"):
            columns.append(f"{stage}_{measure} DOUBLE")
        columns.append(f"{load}_load DOUBLE")
    return _struct(", ".join(columns))


# Log columns in file order.
GENERAL_STATS = _struct(
    "date BIGINT, engine_version INT, host STRING, run INT, server_cpu DOUBLE, client_cpu DOUBLE, "
    "network DOUBLE, network_latency DOUBLE, network_loss DOUBLE, source_system STRING, "
    "target_system STRING, table STRING, server_bufferpool_size INT, client_bufferpool_size INT, "
    "buffer_size INT, compression STRING, format INT, skip_ser INT, skip_deser INT, read_par INT, "
    "read_partitions INT, deser_par INT, comp_par INT, send_par INT, rcv_par INT, decomp_par INT, "
    "ser_par INT, write_par INT, time DOUBLE, datasize BIGINT, avg_cpu_server DOUBLE, avg_cpu_client DOUBLE"
)
CLIENT_TIMINGS = _timings(CLIENT_STAGES, ("free", "decomp", "ser", "write"))
SERVER_TIMINGS = _timings(SERVER_STAGES, ("free", "deser", "comp", "send"))
SWEEP_LOG = _struct(
    "date BIGINT, engine_version INT, host STRING, run INT, system STRING, table STRING, "
    "compression STRING, format INT, network_parallelism INT, bufpool_size INT, buff_size INT, "
    "network DOUBLE, network_latency DOUBLE, network_loss DOUBLE, client_readmode INT, client_cpu DOUBLE, "
    "client_write_par INT, client_decomp_par INT, server_cpu DOUBLE, server_read_par INT, "
    "server_read_partitions INT, server_deser_par INT, server_comp_par INT, time DOUBLE, datasize BIGINT, "
    "avg_cpu_server DOUBLE, avg_cpu_client DOUBLE"
)


def read_run_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A log with a header line. Columns go by position, so a renamed header still reads."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def _timing_lines(spark: SparkSession, folder: str, side: str, pattern: str | None) -> DataFrame:
    """Every line but the headers, parsed as a whole: which columns are asked for decides nothing."""
    schema = {"server": SERVER_TIMINGS, "client": CLIENT_TIMINGS}[side]
    lines = spark.read.option("pathGlobFilter", pattern or f"*_{side}_timings.csv").text(folder)
    line = F.rtrim("value")
    whole = T.StructType([*schema.fields, T.StructField("_rejected", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rejected"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.fields)
    return lines.filter((line != "") & ~F.startswith(line, F.lit(schema.names[0] + ","))).select(
        F.from_csv(line, ddl, options).alias("row"), line.alias("line"), F.col("_metadata.file_name").alias("source_file")
    )


def read_timing_files(spark: SparkSession, folder: str, side: str, pattern: str | None = None) -> DataFrame:
    """All ``*_<side>_timings.csv`` files of a folder with the file each row came from.

    ``side`` is ``server`` or ``client``. Lines that do not parse are in ``rejected_timing_lines``; a
    file that cannot be read, or goes away meanwhile, fails the job.
    """
    lines = _timing_lines(spark, folder, side, pattern)
    return lines.filter(F.col("row._rejected").isNull()).select("row.*", "source_file").drop("_rejected")


def rejected_timing_lines(spark: SparkSession, folder: str, side: str, pattern: str | None = None) -> DataFrame:
    """``source_file, line`` of the lines that ``read_timing_files`` leaves out."""
    lines = _timing_lines(spark, folder, side, pattern)
    return lines.filter(F.col("row._rejected").isNotNull()).select("source_file", "line")
