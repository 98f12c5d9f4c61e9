"""Waiting, processing and throughput of pipeline stages from their event log.

The log is ``(transfer_id, component, thread, event, ts_us, seq)``: ``ts_us`` in microseconds and
``seq`` the place in the log, which is the order events are read in. One thread of one transfer may
own most of the log, so its events are never brought together. The log is cut into chunks of ``seq``;
each chunk is folded on its own into one row per thread, and what a chunk could not know - the last
push, pop or start before it - is supplied when these rows are combined. Pops and pushes that wait
for such a value enter as a count and a sum of times, because ``sum(ts - x) = sum(ts) - n * x``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THREAD = ("transfer_id", "component", "thread")
CHUNK_ROWS = 1_000_000

_WIDE = "decimal(20,0)"  # sums of absolute microseconds outgrow 64 bits


def _us(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def _wide(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value.cast(_WIDE))), F.lit(0)).cast("decimal(38,0)")


def chunk_of(seq: str, chunk_rows: int) -> Column:
    return F.floor(F.col(seq) / F.lit(chunk_rows)).cast("bigint")


def chunk_summaries(log: DataFrame, chunk_rows: int = CHUNK_ROWS, keys: Sequence[str] = THREAD) -> DataFrame:
    """One row per thread and chunk of at most ``chunk_rows`` log rows. One shuffle of the log."""
    ts, event = F.col("ts_us"), F.col("event")
    chunked = log.select(*keys, "event", "ts_us", "seq", chunk_of("seq", chunk_rows).alias("chunk"))
    before = (
        Window.partitionBy(*keys, "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    )

    def last(kind: str) -> Column:
        return F.last(F.when(event == kind, ts), ignorenulls=True).over(before)

    seen = chunked.withColumns({"push": last("push"), "pop": last("pop"), "start": last("start")})
    push, pop, start = F.col("push"), F.col("pop"), F.col("start")
    is_pop, is_push, is_end = event == "pop", event == "push", event == "end"
    open_pop = is_pop & push.isNull()
    after_start, no_start = open_pop & start.isNotNull(), open_pop & start.isNull()
    open_push = is_push & pop.isNull()
    end_popped = is_end & pop.isNotNull()
    end_unknown = is_end & pop.isNull()

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    return seen.groupBy(*keys, "chunk").agg(
        # settled inside the chunk
        _us(is_pop & push.isNotNull(), ts - push).alias("wait"),
        (_us(is_push & pop.isNotNull(), ts - pop) + _us(end_popped & push.isNotNull(), ts - push)).alias("proc"),
        count(is_push & pop.isNotNull()).alias("blocks"),
        # pops before the chunk's first push: wait for an earlier push, else use the start
        count(after_start).alias("pops_started"),
        _wide(after_start, ts).alias("pops_started_ts"),
        _us(after_start, ts - start).alias("pops_started_wait"),
        count(no_start).alias("pops_open"),
        _wide(no_start, ts).alias("pops_open_ts"),
        # pushes before the chunk's first pop
        count(open_push).alias("pushes_open"),
        _wide(open_push, ts).alias("pushes_open_ts"),
        # ends that miss the last push, the last pop or both
        count(end_popped & push.isNull()).alias("ends_popped"),
        _wide(end_popped & push.isNull(), ts).alias("ends_popped_ts"),
        _us(end_unknown & push.isNotNull(), ts - push).alias("ends_pushed_proc"),
        count(end_unknown & push.isNull()).alias("ends_open"),
        _wide(end_unknown & push.isNull(), ts).alias("ends_open_ts"),
        # what later chunks need
        F.max_by(F.when(is_push, ts), F.when(is_push, F.col("seq"))).alias("last_push"),
        F.max_by(F.when(is_pop, ts), F.when(is_pop, F.col("seq"))).alias("last_pop"),
        F.max_by(F.when(event == "start", ts), F.when(event == "start", F.col("seq"))).alias("last_start"),
        F.max_by(F.when(is_end, ts), F.when(is_end, F.col("seq"))).alias("last_end"),
        F.min_by(ts, F.col("seq")).alias("first_ts"),
        F.max_by(ts, F.col("seq")).alias("last_ts"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )


def combine_summaries(
    chunks: DataFrame, keys: Sequence[str] = THREAD, order: Sequence[str] = ("chunk",)
) -> DataFrame:
    """Waiting, processing, overall (whole ms) and blocks per thread from its chunk rows in order."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def carried(name: str) -> Column:
        return F.last(name, ignorenulls=True).over(before).cast("decimal(38,0)")

    known = chunks.withColumns(
        {"_push": carried("last_push"), "_pop": carried("last_pop"), "_start": carried("last_start")}
    )
    push, pop, start = F.col("_push"), F.col("_pop"), F.col("_start")

    def settle(stamps: str, n: str, reference: Column) -> Column:
        return (F.col(stamps) - F.col(n) * reference).cast("bigint")

    late_wait = F.when(
        push.isNotNull(),
        settle("pops_started_ts", "pops_started", push) + settle("pops_open_ts", "pops_open", push),
    ).otherwise(
        F.col("pops_started_wait") + F.when(start.isNotNull(), settle("pops_open_ts", "pops_open", start)).otherwise(0)
    )
    popped, pushed = pop.isNotNull(), push.isNotNull()
    late_proc = (
        F.when(popped, settle("pushes_open_ts", "pushes_open", pop)).otherwise(0)
        + F.when(pushed, settle("ends_popped_ts", "ends_popped", push)).otherwise(0)
        + F.when(popped, F.col("ends_pushed_proc")).otherwise(0)
        + F.when(popped & pushed, settle("ends_open_ts", "ends_open", push)).otherwise(0)
    )
    late_blocks = F.when(popped, F.col("pushes_open")).otherwise(0)
    settled = known.withColumns(
        {
            "wait_us": F.col("wait") + late_wait,
            "proc_us": F.col("proc") + late_proc,
            "handled": F.col("blocks") + late_blocks,
        }
    )
    place = F.struct(*order)

    def newest(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), place))

    span = F.coalesce(
        newest("last_end") - newest("last_start"),
        F.max_by("last_ts", place) - F.min_by("first_ts", place),
    )

    def whole_ms(us: Column) -> Column:
        return F.floor(us / 1000).cast("bigint")

    return settled.groupBy(*keys).agg(
        whole_ms(F.sum("wait_us")).alias("waiting_ms"),
        whole_ms(F.sum("proc_us")).alias("processing_ms"),
        whole_ms(span).alias("overall_ms"),
        F.sum("handled").alias("blocks"),
    )


def thread_metrics(log: DataFrame, block_kib: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per thread: waiting, processing, overall ms, blocks, and MiB/s in all and per block."""
    return with_throughput(combine_summaries(chunk_summaries(log, chunk_rows)), block_kib)


def with_throughput(threads: DataFrame, block_kib: int) -> DataFrame:
    moved = F.col("blocks") * F.lit(block_kib * 1024)

    def per_second(ms: str) -> Column:
        rate = moved / (F.col(ms) / 1000.0) / (1024 * 1024)
        return F.when(F.col(ms) > 0, rate).otherwise(F.lit(0.0))

    return threads.withColumns(
        {"throughput": per_second("overall_ms"), "throughput_pb": per_second("processing_ms")}
    )


def component_metrics(threads: DataFrame, strict: bool = False) -> DataFrame:
    """Roll-up over a component's threads: means, but the sum of total throughput, and deviations.

    The deviation of total throughput is taken from that sum, as in the log format this models;
    ``strict`` takes it from the mean.
    """
    keys = ("transfer_id", "component")
    means = ("waiting_ms", "processing_ms", "overall_ms", "throughput_pb")
    n = F.count("*")
    total = F.sum("throughput")
    # mean((x - total)^2) = variance + (mean - total)^2, so one aggregation is enough
    around_total = F.sqrt(F.var_pop("throughput") + F.pow(total / n - total, F.lit(2)))
    return threads.groupBy(*keys).agg(
        n.alias("threads"),
        *[F.avg(m).alias(m) for m in means],
        total.alias("throughput"),
        *[F.stddev_pop(m).alias(f"{m}_sd") for m in means],
        (F.stddev_pop("throughput") if strict else around_total).alias("throughput_sd"),
    )


def timing_row(components: DataFrame, loads: DataFrame | None, stages: Sequence[str]) -> DataFrame:
    """One wide row per transfer: four measures per component, and a queue load per component."""
    measures = {
        "wait_time": "waiting_ms",
        "proc_time": "processing_ms",
        "throughput": "throughput",
        "throughput_pb": "throughput_pb",
    }
    wide = components.groupBy("transfer_id").agg(
        *[
            F.coalesce(F.max(F.when(F.col("component") == s, F.col(m))), F.lit(0.0)).alias(f"{s}_{name}")
            for s in stages
            for name, m in measures.items()
        ]
    )
    return wide if loads is None else wide.join(loads, "transfer_id", "left")
