"""Stage event logs as they are written: records in reading order, without numbers of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .footers import in_file_order
from .lines import RANGE_BYTES, split_text_file

EVENT_FIELDS = "transfer_id long, component string, thread long, event string, ts_us long"


def read_event_log(
    spark: SparkSession, path: str, fmt: str = "csv", fields: str = EVENT_FIELDS, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """The log's records with ``seq``, their place in it: files by name, records as they stand in them.

    That is the order in which the metrics read a thread's events. Text logs have one record a line, comma between the
    fields; a line that does not parse fails the job. Nothing is sorted.
    """
    if fmt == "parquet":
        return in_file_order(spark, path, "seq")
    if fmt != "csv":
        raise ValueError(f"unknown log format {fmt!r}")
    lines = split_text_file(spark, path, 1, range_bytes=range_bytes)
    record = F.from_csv("value", F.lit(fields), {"mode": "FAILFAST"})
    return lines.select(record.alias("record"), F.col("line_no").alias("seq")).select("record.*", "seq")
