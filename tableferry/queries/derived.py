"""Inputs of the registered queries, derived from the given tables.

Column expressions are written once, in the SQL both engines share; ``div`` is the only word that
differs (``//`` in the checking engine). Rates and times are whole numbers over powers of two, so
sums of them are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import CLIENT_STAGES, SERVER_STAGES
from ..schema import struct_of

CENTS = "CAST(ROUND(o_totalprice * 100) AS BIGINT)"
LINE_CENTS = "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"


def pick(index: str, *values) -> str:
    """SQL CASE choosing the index-th value."""
    arms = " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


def _when(condition: str, then: str, otherwise: str) -> str:
    return f"CASE WHEN {condition} THEN {then} ELSE {otherwise} END"


K, C = "o_orderkey", "o_custkey"
_PATTERN = f"({K} div 10) % 3"
_WIDTH = pick(f"({K} div 180) % 4", 1, 2, 4, 8)

RUN_STATS = {
    "date": K,
    "engine_version": "8",
    "host": f"concat('host-', CAST({K} % 5 AS STRING))",
    "run": f"1 + {K} % 3",
    "server_cpu": f"8 + 8 * ({C} % 2)",
    "client_cpu": pick(f"({C} div 2) % 2", 2, 8),
    "network": pick(f"({C} div 4) % 2", 0, 125),
    "source_system": pick(f"({C} div 8) % 2", "csv", "postgres"),
    "target_system": pick(f"({C} div 16) % 3", "csv", "pandas", "spark"),
    "table": pick(f"({C} div 48) % 4", "lineitem_sf10", "ss13husallm", "iotm", "inputeventsm"),
    "buffer_size": pick(f"({K} div 30) % 3", 256, 512, 1024),
    "compression": pick(f"{K} % 5", "nocomp", "zstd", "lz4", "lzo", "snappy"),
    "format": f"1 + ({K} div 90) % 2",
    "skip_ser": f"({K} div 5) % 2",
    **{f"{s}_par": _when(f"{_PATTERN} = 1", _WIDTH, "1") for s in SERVER_STAGES},
    **{f"{s}_par": _when(f"{_PATTERN} = 2", _WIDTH, "1") for s in CLIENT_STAGES},
    "read_partitions": _when(f"({K} div 720) % 4 = 3", "2", "1"),
    "time": f"({CENTS} div 1000) / 64.0",
    "datasize": f"{CENTS} * {pick(f'{K} % 5', 10, 3, 5, 6, 4)}",
    "avg_cpu_server": f"({CENTS} % 1600) / 8.0",
    "avg_cpu_client": f"({CENTS} % 800) / 8.0",
}


def _timings(stages: tuple[str, ...], loads: tuple[str, ...], seed: int, strangers: int) -> dict[str, str]:
    """A timing log of all orders; every ``strangers``-th record is of a transfer without run statistics."""
    columns = {"transfer_id": _when(f"{K} % {strangers} = 0", f"{K} + 1000000000", K), "total_time": f"({CENTS} div 1000) / 64.0"}
    for i, (stage, load) in enumerate(zip(stages, loads), seed):
        rate = f"(({CENTS} + {997 * i}) % 9973 + 100) / 8.0"
        if stage in ("comp", "decomp"):
            rate = _when(f"{K} % 5 = 0", "0.0", rate)
        columns[f"{stage}_wait_time"] = f"(({CENTS} + {131 * i}) % 5003) / 4.0"
        columns[f"{stage}_proc_time"] = f"(({CENTS} + {257 * i}) % 7001) / 4.0"
        columns[f"{stage}_throughput"] = f"(({CENTS} * {i + 1}) % 4001) / 8.0"
        columns[f"{stage}_throughput_pb"] = rate
        columns[f"{load}_load"] = f"(({CENTS} + {17 * i}) % 97) / 2.0"
    return columns


SERVER_LOG = _timings(SERVER_STAGES, ("free", "deser", "comp", "send"), 1, 11)
CLIENT_LOG = _timings(CLIENT_STAGES, ("free", "decomp", "ser", "write"), 5, 7)

P, S, L = "l_partkey", "l_suppkey", "l_orderkey"
_AXIS = f"({L} % 24) div 4"
_STEP = pick(f"{L} % 4", 1, 2, 4, 8)
MEASUREMENTS = {
    "date": L,
    "engine_version": "8",
    "run": "l_linenumber",
    "host": f"concat('host-', CAST({S} % 5 AS STRING))",
    "system": pick(f"{P} % 2", "csv", "postgres"),
    "table": pick(f"({P} div 2) % 4", "lineitem_sf10", "ss13husallm", "iotm", "inputeventsm"),
    "compression": pick(f"({P} div 8) % 5", "nocomp", "zstd", "lz4", "lzo", "snappy"),
    "format": f"1 + {S} % 2",
    "network_parallelism": f"1 + ({S} div 6) % 2",
    "bufpool_size": pick(f"({P} div 40) % 2", 8192, 16384),
    "buff_size": pick(f"({P} div 80) % 3", 256, 1024, 2048),
    "network": pick(f"{S} % 3", 0, 125, 1000),
    "network_latency": "0",
    "network_loss": "0",
    "client_readmode": "1",
    "client_cpu": pick("l_linenumber % 2", 2, 16),
    "client_write_par": _when(f"{_AXIS} = 0", _STEP, "1"),
    "client_decomp_par": _when(f"{_AXIS} IN (1, 5)", _STEP, "1"),
    "server_cpu": "16",
    "server_read_par": _when(f"{_AXIS} = 2", _STEP, "1"),
    "server_read_partitions": _when(f"({L} div 24) % 8 = 7", "2", "1"),
    "server_deser_par": _when(f"{_AXIS} = 3", _STEP, "1"),
    "server_comp_par": _when(f"{_AXIS} IN (4, 5)", _STEP, "1"),
    "time": f"({LINE_CENTS} div 1000) / 64.0",
    "datasize": f"{LINE_CENTS} * {pick(f'({P} div 8) % 5', 10, 3, 5, 6, 4)}",
}

# lineitem as a transfer table: the 11 columns of the given table, the date as text.
LINEITEM = struct_of(
    [
        ("l_orderkey", "INT", 4),
        ("l_partkey", "INT", 4),
        ("l_suppkey", "INT", 4),
        ("l_linenumber", "INT", 4),
        ("l_quantity", "DOUBLE", 8),
        ("l_extendedprice", "DOUBLE", 8),
        ("l_discount", "DOUBLE", 8),
        ("l_tax", "DOUBLE", 8),
        ("l_returnflag", "CHAR", 1),
        ("l_linestatus", "CHAR", 1),
        ("l_shipdate", "STRING", 11),
    ],
    wide_ints=True,
)
LINEITEM_ORDER = LINEITEM.names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    out = []
    for name, sql in columns.items():
        value = F.expr(sql)
        out.append((value.cast("double") if "/" in sql else value).alias(name))
    return df.select(*out)


def as_transfer_table(df: DataFrame, *others: str) -> DataFrame:
    """The transfer table's columns of lineitem rows, and others besides: date as ``yyyy-MM-dd`` text."""
    dated = df.withColumn("l_shipdate", F.col("l_shipdate").cast("date").cast("string"))
    return dated.select(*LINEITEM.names, *others)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transfer table: date as ``yyyy-MM-dd`` text, everything else as it is stored."""
    return as_transfer_table(table(spark, sf_dir, "lineitem"))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "orders"), RUN_STATS)


def server_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "orders"), SERVER_LOG)


def client_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "orders"), CLIENT_LOG)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "lineitem"), MEASUREMENTS)


THREAD_OF = {
    "transfer_id": "user_id % 5",
    "component": pick("user_id % 4", "rcv", "decomp", "ser", "write"),
    "thread": "(user_id div 20) % 3",
}


def as_event_log(events: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Stage events from user events: first of a thread is start, last is end, errors are left out.

    Views and clicks are pops, purchases and signups are pushes. There is one row of bounds per
    thread of a transfer (60 at any size).
    """
    log = events.select(
        *[F.expr(sql).alias(name) for name, sql in THREAD_OF.items()],
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("event_id").alias("seq"),
        "event_type",
    )
    keys = list(THREAD_OF)
    if bounds is None:
        bounds = log_bounds(events)
    kind = (
        F.when(F.col("seq") == F.col("first_seq"), "start")
        .when(F.col("seq") == F.col("last_seq"), "end")
        .when(F.col("event_type").isin("view", "click"), "pop")
        .when(F.col("event_type").isin("purchase", "signup"), "push")
        .otherwise(F.col("event_type"))  # a kind the log's readers do not know and pass over
    )
    named = log.join(bounds, keys).withColumn("event", kind)
    return named.select(*keys, "event", "ts_us", "seq")


def log_bounds(events: DataFrame) -> DataFrame:
    threads = events.select(*[F.expr(sql).alias(name) for name, sql in THREAD_OF.items()], "event_id")
    return threads.groupBy(*THREAD_OF).agg(F.min("event_id").alias("first_seq"), F.max("event_id").alias("last_seq"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_event_log(table(spark, sf_dir, "events"))


def queue_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue lengths once a minute: how many events of each kind fell into it."""
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("bigint")

    def count(kind: str) -> F.Column:
        return F.count(F.when(F.col("event_type") == kind, 1))

    return (
        table(spark, sf_dir, "events")
        .groupBy(minute.alias("minute"))
        .agg(
            count("view").alias("free"),
            count("click").alias("compressed"),
            count("purchase").alias("decompressed"),
            count("signup").alias("serialized"),
        )
    )


def control_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(MESSAGE_SQL).alias("message"))


MESSAGE_SQL = (
    "CASE WHEN o_orderkey % 13 = 0 THEN 'not json' "
    "WHEN o_orderkey % 11 = 0 THEN '{\"operation\":\"reboot\",\"payload\":{}}' "
    "WHEN o_orderkey % 7 = 0 THEN '{\"operation\":\"get_environment\",\"payload\":{\"totalTime_ms\":12}}' "
    "WHEN o_orderkey % 5 = 0 THEN concat('{\"operation\":\"set_environment\",\"payload\":{\"writeParallelism\":\"', "
    "CAST(1 + o_custkey % 8 AS STRING), '\"}}') "
    "ELSE concat('{\"operation\":\"set_environment\",\"payload\":{\"writeParallelism\":\"', "
    "CAST(1 + o_custkey % 8 AS STRING), '\",\"decompParallelism\":\"', CAST(1 + o_orderkey % 4 AS STRING), "
    "'\",\"serParallelism\":\"', CAST(1 + o_custkey % 3 AS STRING), '\"}}') END"
)


# --- the same inputs as common table expressions for the checking engine ---------------------


def _cte(name: str, columns: dict[str, str], source: str) -> str:
    parts = []
    for column, sql in columns.items():
        text = sql.replace(" div ", " // ")
        if "/" in sql:
            text = f"CAST({text} AS DOUBLE)"
        parts.append(f'{text} AS "{column}"')
    return f"{name} AS (SELECT {', '.join(parts)} FROM {source})"


RUN_STATS_SQL = _cte("run_stats", RUN_STATS, "orders")
SERVER_SQL = _cte("server_timings", SERVER_LOG, "orders")
CLIENT_SQL = _cte("client_timings", CLIENT_LOG, "orders")
MEASUREMENTS_SQL = _cte("measurements", MEASUREMENTS, "lineitem")
LINEITEM_SQL = (
    "xfer AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
    "l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem)"
)
LINES_SQL = (
    LINEITEM_SQL + ", lines AS (SELECT *, concat(l_orderkey, ',', l_partkey, ',', l_suppkey, ',', l_linenumber, ',', "
    "printf('%.2f', l_quantity), ',', printf('%.2f', l_extendedprice), ',', printf('%.2f', l_discount), ',', "
    "printf('%.2f', l_tax), ',', l_returnflag, ',', l_linestatus, ',', l_shipdate) AS line FROM xfer)"
)
_THREADS = ", ".join(f'{sql.replace(" div ", " // ")} AS {name}' for name, sql in THREAD_OF.items())
EVENT_LOG_SQL = (
    f"threads AS (SELECT {_THREADS}, epoch_us(ts) AS ts_us, event_id AS seq, event_type FROM events), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY transfer_id, component, thread ORDER BY seq) AS rn, "
    "count(*) OVER (PARTITION BY transfer_id, component, thread) AS n FROM threads), "
    "event_log AS (SELECT transfer_id, component, thread, CASE WHEN rn = 1 THEN 'start' WHEN rn = n THEN 'end' "
    "WHEN event_type IN ('view', 'click') THEN 'pop' WHEN event_type IN ('purchase', 'signup') THEN 'push' "
    "ELSE event_type END AS event, ts_us, seq FROM placed)"
)
SAMPLES_SQL = (
    "queue_samples AS (SELECT epoch_us(ts) // 60000000 AS minute, "
    "count(*) FILTER (event_type = 'view') AS free, count(*) FILTER (event_type = 'click') AS compressed, "
    "count(*) FILTER (event_type = 'purchase') AS decompressed, "
    "count(*) FILTER (event_type = 'signup') AS serialized FROM events GROUP BY 1)"
)
MESSAGES_SQL = f"control_messages AS (SELECT o_orderkey, {MESSAGE_SQL} AS message FROM orders)"
