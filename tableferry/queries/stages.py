"""Stage metrics over the event log, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import CLIENT_STAGES
from ..functions.messages import metrics_payload
from ..functions.rates import wait_share
from ..operators import stage_metrics as m
from ..operators import summarize
from ..session import work_dir
from ..sources import EVENT_FIELDS, read_event_log
from ..storage import list_files, qualified
from ..streaming import ingest, live, merged
from ..streaming.seen import UnseenRows
from . import derived as d
from .registry import query

BLOCK_KIB = 64

# Step by step in one window per thread: the checking form, not the distributed one.
METRICS_SQL = (
    f"{d.EVENT_LOG_SQL}, seen AS (SELECT *, "
    "last_value(CASE WHEN event = 'push' THEN ts_us END IGNORE NULLS) OVER w AS lpush, "
    "last_value(CASE WHEN event = 'pop' THEN ts_us END IGNORE NULLS) OVER w AS lpop, "
    "last_value(CASE WHEN event = 'start' THEN ts_us END IGNORE NULLS) OVER w AS lstart FROM event_log "
    "WINDOW w AS (PARTITION BY transfer_id, component, thread ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND 1 PRECEDING)), steps AS (SELECT *, "
    "CASE WHEN event = 'pop' THEN coalesce(ts_us - lpush, ts_us - lstart, 0) ELSE 0 END AS wait_us, "
    "CASE WHEN event = 'push' AND lpop IS NOT NULL THEN ts_us - lpop "
    "WHEN event = 'end' AND lpop IS NOT NULL AND lpush IS NOT NULL THEN ts_us - lpush ELSE 0 END AS proc_us, "
    "CASE WHEN event = 'push' AND lpop IS NOT NULL THEN 1 ELSE 0 END AS handled FROM seen), "
    "thread_metrics AS (SELECT transfer_id, component, thread, CAST(sum(wait_us) // 1000 AS BIGINT) AS waiting_ms, "
    "CAST(sum(proc_us) // 1000 AS BIGINT) AS processing_ms, "
    "coalesce(max(CASE WHEN event = 'end' THEN ts_us END) - max(CASE WHEN event = 'start' THEN ts_us END), "
    "max(ts_us) - min(ts_us)) // 1000 AS overall_ms, CAST(sum(handled) AS BIGINT) AS blocks "
    "FROM steps GROUP BY 1, 2, 3), "
    f"rated AS (SELECT *, CASE WHEN overall_ms > 0 THEN blocks * {BLOCK_KIB * 1024} / (overall_ms / 1000.0) / 1048576 "
    f"ELSE 0.0 END AS throughput, CASE WHEN processing_ms > 0 THEN blocks * {BLOCK_KIB * 1024} / "
    "(processing_ms / 1000.0) / 1048576 ELSE 0.0 END AS throughput_pb FROM thread_metrics)"
)
COMPONENTS_SQL = (
    METRICS_SQL + ", components AS (SELECT transfer_id, component, count(*) AS threads, "
    "round(avg(waiting_ms), 6) AS waiting_ms, round(avg(processing_ms), 6) AS processing_ms, "
    "round(avg(overall_ms), 6) AS overall_ms, round(avg(throughput_pb), 12) AS throughput_pb, "
    "round(sum(throughput), 12) AS throughput FROM rated GROUP BY 1, 2)"
)
WITH_METRICS = f"WITH {METRICS_SQL} "
KEYS_SQL = "transfer_id, component, thread"


def _threads(spark, sf_dir):
    return m.combine_summaries(m.chunk_summaries(d.event_log(spark, sf_dir)))


def _rated(spark, sf_dir):
    return m.with_throughput(_threads(spark, sf_dir), BLOCK_KIB)


def _rounded(df, digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


ROUNDED = {"waiting_ms": 6, "processing_ms": 6, "overall_ms": 6, "throughput_pb": 12, "throughput": 12}


@query("met1_waiting", WITH_METRICS + f"SELECT {KEYS_SQL}, waiting_ms FROM thread_metrics")
def waiting(spark, sf_dir):
    return _threads(spark, sf_dir).select("transfer_id", "component", "thread", "waiting_ms")


@query("met2_processing", WITH_METRICS + f"SELECT {KEYS_SQL}, processing_ms FROM thread_metrics")
def processing(spark, sf_dir):
    return _threads(spark, sf_dir).select("transfer_id", "component", "thread", "processing_ms")


@query("met3_blocks", WITH_METRICS + f"SELECT {KEYS_SQL}, blocks FROM thread_metrics")
def handled_blocks(spark, sf_dir):
    return _threads(spark, sf_dir).select("transfer_id", "component", "thread", "blocks")


@query("met4_overall", WITH_METRICS + f"SELECT {KEYS_SQL}, overall_ms FROM thread_metrics")
def overall(spark, sf_dir):
    return _threads(spark, sf_dir).select("transfer_id", "component", "thread", "overall_ms")


@query(
    "met5_whole_milliseconds",
    WITH_METRICS + f"SELECT {KEYS_SQL}, waiting_ms, processing_ms, overall_ms, blocks FROM thread_metrics",
)
def whole_milliseconds(spark, sf_dir):
    """All thread measures at the default chunk size."""
    return m.combine_summaries(m.chunk_summaries(d.event_log(spark, sf_dir)))


@query(
    "met6_thread_throughput",
    WITH_METRICS + f"SELECT {KEYS_SQL}, round(throughput, 12) AS throughput, round(throughput_pb, 12) AS throughput_pb "
    "FROM rated",
)
def thread_throughput(spark, sf_dir):
    return _rounded(_rated(spark, sf_dir), ROUNDED).select(
        "transfer_id", "component", "thread", "throughput", "throughput_pb"
    )


@query("met7_component_rollup", f"WITH {COMPONENTS_SQL} SELECT * FROM components")
def component_rollup(spark, sf_dir):
    rolled = _rounded(m.component_metrics(_rated(spark, sf_dir)), ROUNDED)
    return rolled.select("transfer_id", "component", "threads", *ROUNDED)


@query(
    "met8_deviations",
    WITH_METRICS + ", t AS (SELECT *, sum(throughput) OVER (PARTITION BY transfer_id, component) AS total FROM rated) "
    "SELECT transfer_id, component, round(stddev_pop(waiting_ms), 6) AS waiting_ms_sd, "
    "round(stddev_pop(processing_ms), 6) AS processing_ms_sd, round(stddev_pop(overall_ms), 6) AS overall_ms_sd, "
    "round(stddev_pop(throughput_pb), 9) AS throughput_pb_sd, "
    "round(sqrt(avg((throughput - total) * (throughput - total))), 9) AS throughput_sd FROM t GROUP BY 1, 2",
)
def deviations(spark, sf_dir):
    digits = {"waiting_ms_sd": 6, "processing_ms_sd": 6, "overall_ms_sd": 6, "throughput_pb_sd": 9, "throughput_sd": 9}
    rolled = m.component_metrics(_rated(spark, sf_dir))
    return _rounded(rolled, digits).select("transfer_id", "component", *digits)


_WIDE_SQL = ", ".join(
    f"coalesce(max({column}) FILTER (component = '{s}'), 0) AS {s}_{name}"
    for s in CLIENT_STAGES
    for name, column in (
        ("wait_time", "waiting_ms"),
        ("proc_time", "processing_ms"),
        ("throughput", "throughput"),
        ("throughput_pb", "throughput_pb"),
    )
)
_QUEUES = ("free", "compressed", "decompressed", "serialized")


@query(
    "met4_log_without_numbers",
    WITH_METRICS + f"SELECT {KEYS_SQL}, waiting_ms, processing_ms, overall_ms, blocks FROM thread_metrics",
)
def log_without_numbers(spark, sf_dir):
    """The log as text, in the order it was kept in and without that order's numbers; a record's line is its place."""
    path = work_dir(spark, "event-log")
    fields = [f.split()[0] for f in EVENT_FIELDS.split(", ")]
    ordered = d.event_log(spark, sf_dir).orderBy("seq")
    ordered.select(F.concat_ws(",", *[F.col(c).cast("string") for c in fields])).write.text(path)
    return m.combine_summaries(m.chunk_summaries(read_event_log(spark, path, range_bytes=1 << 20)))


@query(
    "met9_timing_row",
    f"WITH {COMPONENTS_SQL}, {d.SAMPLES_SQL}, loads AS (SELECT avg(free) AS free_load, avg(compressed) AS decomp_load, "
    "avg(decompressed) AS ser_load, avg(serialized) AS write_load FROM queue_samples), "
    f"wide AS (SELECT transfer_id, {_WIDE_SQL} FROM components GROUP BY 1) "
    "SELECT wide.*, round(free_load, 9) AS free_load, round(decomp_load, 9) AS decomp_load, "
    "round(ser_load, 9) AS ser_load, round(write_load, 9) AS write_load FROM wide, loads",
)
def timing_row(spark, sf_dir):
    """The samples cover all transfers, so each transfer's row gets the same loads."""
    rolled = _rounded(m.component_metrics(_rated(spark, sf_dir)), ROUNDED)
    names = ("free_load", "decomp_load", "ser_load", "write_load")
    samples = d.queue_samples(spark, sf_dir).select(*[F.col(q).alias(n) for q, n in zip(_QUEUES, names)])
    loads = _rounded(summarize.average_load(samples, names), dict.fromkeys(names, 9))
    each = loads.select(F.struct(*names).alias("load")).scalar()  # one row, given to every transfer there is
    wide = m.timing_row(rolled, None, CLIENT_STAGES)
    return wide.withColumns({n: each.getField(n) for n in names})


@query(
    "met10_wait_share",
    f"WITH {COMPONENTS_SQL} SELECT transfer_id, component, round(CASE WHEN waiting_ms + processing_ms = 0 THEN 0 ELSE "
    "waiting_ms / (waiting_ms + processing_ms) END, 9) AS wait_share FROM components",
)
def wait_shares(spark, sf_dir):
    rolled = _rounded(m.component_metrics(_rated(spark, sf_dir)), ROUNDED)
    share = wait_share(F.col("waiting_ms"), F.col("processing_ms"))
    return rolled.select("transfer_id", "component", F.round(share, 9).alias("wait_share"))


@query(
    "agg16_average_load",
    f"WITH {d.SAMPLES_SQL} SELECT "
    + ", ".join(f"round(coalesce(avg({q}), 0), 9) AS {q}" for q in _QUEUES)
    + " FROM queue_samples",
)
def average_load(spark, sf_dir):
    loads = summarize.average_load(d.queue_samples(spark, sf_dir), _QUEUES)
    return _rounded(loads, dict.fromkeys(_QUEUES, 9))


@query(
    "fn14_metrics_payload",
    WITH_METRICS + ", c AS (SELECT transfer_id, component, avg(waiting_ms) AS w, avg(processing_ms) AS p, "
    "avg(overall_ms) AS o FROM rated GROUP BY 1, 2) SELECT transfer_id, component, round(w, 6) AS waiting, "
    "round(p, 6) AS processing, round(o, 6) AS overall, CAST(count(*) OVER (PARTITION BY transfer_id) AS VARCHAR) "
    "AS components FROM c",
)
def payload(spark, sf_dir):
    """The JSON is read back, so that number formats do not matter to the comparison."""
    rolled = m.component_metrics(_rated(spark, sf_dir))
    text = metrics_payload(rolled, ["transfer_id"], {"components": F.count("*")})
    entry = "struct<waitingTime_ms double, processingTime_ms double, totalTime_ms double>"
    names = F.array(*[F.lit(s) for s in CLIENT_STAGES])
    parsed = text.select("transfer_id", F.explode(names).alias("component"), "payload").withColumn(
        "e", F.from_json("payload", "map<string, string>")
    )
    picked = parsed.withColumn("m", F.from_json(F.col("e")[F.col("component")], entry)).filter(F.col("m").isNotNull())
    return picked.select(
        "transfer_id",
        "component",
        F.round("m.waitingTime_ms", 6).alias("waiting"),
        F.round("m.processingTime_ms", 6).alias("processing"),
        F.round("m.totalTime_ms", 6).alias("overall"),
        F.col("e")["components"].alias("components"),
    )


# --- streaming --------------------------------------------------------------------------------


def _event_stream(spark, sf_dir):
    d.table(spark, sf_dir, "events")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _log_stream(spark, sf_dir):
    """The events as they arrive; the first and last of a thread are known from the stored table."""
    bounds = d.log_bounds(d.table(spark, sf_dir, "events"))
    return d.as_event_log(_event_stream(spark, sf_dir), bounds)


@query(
    "str1_live_events",
    f"WITH {d.EVENT_LOG_SQL} SELECT (ts_us // 2000000) * 2000000 AS window_start_us, component, event, "
    "count(*) AS events FROM event_log GROUP BY 1, 2, 3",
)
def live_events(spark, sf_dir):
    stream = _log_stream(spark, sf_dir).withColumn("ts", F.timestamp_micros("ts_us"))
    counts = merged.event_counts(spark, work_dir(spark, "live-events"))
    writer = counts.follow(stream, merged.counted_events, work_dir(spark, "checkpoint"))
    return live.run_available(writer, counts.now)


@query(
    "str2_running_stage_metrics",
    WITH_METRICS + f"SELECT {KEYS_SQL}, waiting_ms, processing_ms, overall_ms, blocks FROM thread_metrics",
)
def running_stage_metrics(spark, sf_dir):
    """The log arrives in several files, a batch each, of interleaved events; the result equals the batch form."""
    source = work_dir(spark, "log-files")
    log = d.event_log(spark, sf_dir)
    log.repartition(4, F.floor(F.col("seq") / 1_000)).write.parquet(source)
    path = work_dir(spark, "running-metrics")
    stream = (
        spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    )
    writer = live.running_stage_metrics(stream, path, work_dir(spark, "checkpoint"))
    return live.run_available(writer, lambda: live.stage_metrics_so_far(spark, path))


@query(
    "str3_windowed_load",
    f"WITH {d.SAMPLES_SQL} SELECT (minute * 60000000 // 3600000000) * 3600000000 AS window_start_us, "
    + ", ".join(f"round(avg({q}), 9) AS {q}" for q in _QUEUES)
    + ", count(*) AS samples FROM queue_samples GROUP BY 1",
)
def windowed_load(spark, sf_dir):
    source = work_dir(spark, "samples")
    samples = d.queue_samples(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.col("minute") * 60))
    samples.repartition(2, "minute").write.parquet(source)
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(source)
    loads = merged.queue_loads(spark, work_dir(spark, "load"), _QUEUES)
    writer = loads.follow(stream, lambda b: merged.summed_loads(b, _QUEUES, every_us=3_600_000_000), work_dir(spark, "checkpoint"))
    state = live.run_available(writer, lambda: merged.mean_loads(loads, _QUEUES))
    return _rounded(state, dict.fromkeys(_QUEUES, 9))


def _a_third(spark, folder: str) -> int:
    """Files a batch, so that three batches take all: an arrival has as many files as its tasks wrote."""
    return -(-len(list_files(qualified(spark, folder))) // 3)


@query("str4_incremental_append", f"WITH {d.CLIENT_SQL} SELECT transfer_id, total_time FROM client_timings")
def incremental_append(spark, sf_dir):
    """Three arrivals, the second repeating a third of the first's ids; every id is stored once."""
    records = d.client_timings(spark, sf_dir).select("transfer_id", "total_time")
    source, path = work_dir(spark, "records"), work_dir(spark, "stored")
    for part in ("transfer_id % 2 = 0", "transfer_id % 2 = 1 OR transfer_id % 3 = 0", "transfer_id % 5 = 0"):
        records.filter(part).write.mode("append").parquet(source)
    stream = ingest.new_files(spark, source, records.schema, "parquet", per_batch=_a_third(spark, source))
    writer = ingest.append_unseen(stream, "transfer_id", path, work_dir(spark, "checkpoint"), records.schema)
    return live.run_available(writer, UnseenRows(spark, path, records.schema, "transfer_id").rows)


@query("str5_continuous_transfer", f"WITH {d.LINES_SQL} SELECT line FROM lines")
def continuous_transfer(spark, sf_dir):
    """Three arrivals of a third each, in as many files as the table has splits, so that no task takes a whole arrival."""
    source, target = work_dir(spark, "arriving"), work_dir(spark, "moved")
    rows = d.lineitem(spark, sf_dir)
    for n in range(3):
        rows.filter(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(3)) == n).write.mode("append").parquet(source)
    stream = ingest.new_files(spark, source, rows.schema, "parquet", per_batch=_a_third(spark, source))
    writer = ingest.continuous_transfer(stream, d.LINEITEM, "csv", target, work_dir(spark, "checkpoint"))
    return live.run_available(writer, lambda: spark.read.text(target).withColumnRenamed("value", "line"))


@query(
    "str6_progress",
    f"WITH {d.EVENT_LOG_SQL} SELECT transfer_id, (max(ts_us) - min(ts_us)) // 1000 AS \"totalTime_ms\", "
    "count(*) FILTER (component = 'write' AND event = 'push') AS \"bufTransferred\" FROM event_log GROUP BY 1",
)
def progress(spark, sf_dir):
    parts = merged.transfer_progress(spark, work_dir(spark, "progress"))
    writer = parts.follow(_log_stream(spark, sf_dir), merged.progress_parts, work_dir(spark, "checkpoint"))
    return live.run_available(writer, lambda: merged.progress_now(parts))
