"""Live metrics on streams of log events and queue samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.stage_metrics import CHUNK_ROWS, THREAD, chunk_of, chunk_summaries, combine_summaries

BATCH = "batch_id"


def windowed_events(
    events: DataFrame, time: str = "ts", every: str = "2 seconds", late: str | None = None, value: str | None = None
) -> DataFrame:
    """Events per tumbling window and component, optionally with the mean of a value.

    Without ``late`` nothing is dropped and windows stay in state for as long as the query runs;
    with it, windows older than the watermark are closed.
    """
    source = events.withWatermark(time, late) if late else events
    measures = [F.count("*").alias("events")]
    if value:
        measures.append(F.avg(value).alias("mean_value"))
    return (
        source.groupBy(F.window(time, every).alias("w"), "component", "event")
        .agg(*measures)
        .select(F.unix_micros("w.start").alias("window_start_us"), "component", "event", *[
            "events", *(["mean_value"] if value else [])])
    )


def windowed_load(
    samples: DataFrame,
    queues: Sequence[str],
    time: str = "ts",
    length: str = "10 minutes",
    slide: str | None = None,
    late: str | None = None,
) -> DataFrame:
    """Mean queue lengths per window; with ``slide`` the windows overlap into a running average."""
    source = samples.withWatermark(time, late) if late else samples
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return (
        source.groupBy(window.alias("w"))
        .agg(*[F.avg(q).alias(q) for q in queues], F.count("*").alias("samples"))
        .select(F.unix_micros("w.start").alias("window_start_us"), *queues, "samples")
    )


def to_changelog(result: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write each micro-batch's changed rows below ``batch_id=<n>``.

    A batch that runs again after a failure replaces its own folder, so each counts once.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return result.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)


def current_state(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every row of a changelog."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c not in (*keys, BATCH)]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_now")).select(*keys, "_now.*")


def running_stage_metrics(
    log: DataFrame, path: str, checkpoint: str, chunk_rows: int = CHUNK_ROWS, keys: Sequence[str] = THREAD
) -> DataStreamWriter:
    """Fold each micro-batch of the event log into per-thread chunk rows, below ``path/chunks/batch_id=<n>``.

    The rows carry the last push, pop and start, so waiting and processing stay exact across
    batches without any keyed state: a thread's new events are folded where they are, however many.
    The batch's events are kept beside them, in order of their chunks, for chunks that batches share. A repeated
    batch replaces its own folders.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        events = batch.select(*keys, "event", "ts_us", "seq").withColumn("chunk", chunk_of("seq", chunk_rows))
        kept = f"{path}/events/{BATCH}={batch_id}"
        events.sortWithinPartitions("chunk").write.mode("overwrite").parquet(kept)
        stored = batch.sparkSession.read.schema(events.schema).parquet(kept)
        chunk_summaries(stored, chunk_rows, keys).write.mode("overwrite").parquet(f"{path}/chunks/{BATCH}={batch_id}")

    return log.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint)


def stage_metrics_so_far(
    spark: SparkSession, path: str, chunk_rows: int = CHUNK_ROWS, keys: Sequence[str] = THREAD
) -> DataFrame:
    """Per-thread metrics of everything streamed so far, whatever order and interleaving the events came in.

    Rows of one thread and chunk whose runs overlap cannot be put in order: these chunks alone are folded again, from
    the events that were kept. All other rows count as they are, in log order.
    """
    chunks = spark.read.parquet(f"{path}/chunks").drop(BATCH)
    unit = [*keys, "chunk"]
    before = Window.partitionBy(*unit).orderBy("first_seq").rowsBetween(Window.unboundedPreceding, -1)
    mixed = chunks.select(*unit, "first_seq", F.max("last_seq").over(before).alias("until"))
    mixed = mixed.filter(F.col("until") >= F.col("first_seq")).select(*unit).distinct()
    events = spark.read.parquet(f"{path}/events").drop(BATCH).join(mixed, unit, "left_semi")
    refolded = chunk_summaries(events, chunk_rows, keys)
    return combine_summaries(chunks.join(mixed, unit, "left_anti").unionByName(refolded), keys, ("first_seq",))


def running_progress(log: DataFrame, keys: Sequence[str] = ("transfer_id",)) -> DataFrame:
    """Elapsed milliseconds and blocks written per transfer, kept up to date on a stream."""
    pushed: Column = (F.col("component") == "write") & (F.col("event") == "push")
    return log.groupBy(*keys).agg(
        F.floor((F.max("ts_us") - F.min("ts_us")) / 1000).cast("bigint").alias("totalTime_ms"),
        F.count(F.when(pushed, 1)).alias("bufTransferred"),
    )


def run_available(writer: DataStreamWriter, then: Callable[[], DataFrame]) -> DataFrame:
    """Process what is there now, in as many batches as the source makes, and return the result."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return then()
