"""Control messages and metric payloads as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import OPERATIONS

MESSAGE = "operation STRING, payload MAP<STRING, STRING>"


def parse_messages(df: DataFrame, column: str = "message") -> DataFrame:
    """Operation and the three settings a ``set_environment`` carries (numbers arrive as text).

    ``status`` tells apart ``ok``, ``unexpected`` (not an operation of the channel) and ``invalid``
    (no JSON, or a setting that is missing or no number); such rows are kept and flagged.
    """
    message = F.from_json(F.col(column), MESSAGE)

    def setting(key: str) -> Column:
        value = F.regexp_extract(F.trim(F.col("_m.payload")[key]), r"^[+-]?\d+", 0)
        return value.try_cast("int")

    parsed = df.withColumn("_m", message).select(
        *df.columns,
        F.col("_m.operation").alias("operation"),
        setting("writeParallelism").alias("write_par"),
        setting("decompParallelism").alias("decomp_par"),
        setting("serParallelism").alias("ser_par"),
    )
    complete = F.col("write_par").isNotNull() & F.col("decomp_par").isNotNull() & F.col("ser_par").isNotNull()
    status = (
        F.when(F.col("operation").isNull(), "invalid")
        .when(~F.col("operation").isin(*OPERATIONS), "unexpected")
        .when((F.col("operation") == "set_environment") & ~complete, "invalid")
        .otherwise("ok")
    )
    return parsed.withColumn("status", status)


def metrics_payload(component_metrics: DataFrame, keys: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """One JSON text per transfer: component -> its five measures, plus flat extra keys.

    ``extra`` holds aggregates over the transfer's component rows; a transfer has few of those.
    """
    measures = F.struct(
        F.col("waiting_ms").alias("waitingTime_ms"),
        F.col("processing_ms").alias("processingTime_ms"),
        F.col("overall_ms").alias("totalTime_ms"),
        F.col("throughput").alias("totalThroughput"),
        F.col("throughput_pb").alias("perBufferThroughput"),
    )
    entries = F.sort_array(F.collect_list(F.struct(F.col("component"), measures.alias("m"))))
    grouped = component_metrics.groupBy(*keys).agg(
        entries.alias("_entries"), *[c.alias(f"_x_{k}") for k, c in (extra or {}).items()]
    )
    body = F.to_json(F.map_from_entries("_entries"))
    if not extra:
        return grouped.select(*keys, body.alias("payload"))
    flat = F.to_json(F.struct(*[F.col(f"_x_{k}").alias(k) for k in extra]))
    joined = F.concat(F.rtrim(body, F.lit("}")), F.lit("},"), F.substr(flat, F.lit(2)))
    return grouped.select(*keys, joined.alias("payload"))
