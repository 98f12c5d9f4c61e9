"""Run statistics and timings: filters, joins, rates, ratios and serial fractions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import CEILINGS, CLIENT_STAGES, CODECS, ENVIRONMENT_SIZES, SERVER_STAGES, STAGES, STORAGE_MODE
from ..functions.labels import lookup, strict_lookup
from ..operators import dedup, ranking, select, slices, summarize
from ..plans.rules import with_ceilings
from . import derived as d
from .registry import query

STATS = f"WITH {d.RUN_STATS_SQL} "
BOTH = f"WITH {d.RUN_STATS_SQL}, {d.SERVER_SQL}, {d.CLIENT_SQL} "
ONE_ENVIRONMENT = {
    "server_cpu": 8,
    "client_cpu": 8,
    "network": 125,
    "source_system": "csv",
    "target_system": "csv",
}
ONE_SQL = " AND ".join(f'"{k}" = {v!r}' for k, v in ONE_ENVIRONMENT.items())
PAR = [f"{s}_par" for s in STAGES]
PAR_ONE_SQL = " AND ".join(f"{p} = 1" for p in [*PAR, "read_partitions"])


# --- projections and filters ------------------------------------------------------------------


@query(
    "prj4_columns_by_name_part",
    f"WITH {d.CLIENT_SQL} SELECT " + ", ".join(f"{s}_throughput_pb AS client_{s}_throughput_pb" for s in CLIENT_STAGES)
    + " FROM client_timings",
)
def columns_by_name_part(spark, sf_dir):
    df = d.client_timings(spark, sf_dir)
    return select.prefixed(df, select.columns_like(df, "throughput_pb"), "client_")


@query("flt1_equal_to_all", STATS + f"SELECT * FROM run_stats WHERE {ONE_SQL}")
def equal_to_all(spark, sf_dir):
    return d.run_stats(spark, sf_dir).filter(select.matches(ONE_ENVIRONMENT))


@query("flt2_family_equals_one", STATS + f"SELECT date, compression, skip_ser FROM run_stats WHERE {PAR_ONE_SQL}")
def family_equals_one(spark, sf_dir):
    df = d.run_stats(spark, sf_dir)
    return df.filter(select.all_equal(select.columns_like(df, "_par"), 1)).select("date", "compression", "skip_ser")


@query("flt3_membership", STATS + "SELECT date, compression, network FROM run_stats WHERE compression IN ('lz4', 'zstd')")
def membership(spark, sf_dir):
    return d.run_stats(spark, sf_dir).filter(F.col("compression").isin("lz4", "zstd")).select(
        "date", "compression", "network"
    )


# --- joins ------------------------------------------------------------------------------------


@query(
    "joi1_stats_with_timings",
    BOTH + "SELECT s.date, t.transfer_id, s.compression, s.read_par, t.read_throughput_pb, t.total_time "
    "FROM run_stats s JOIN server_timings t ON s.date = t.transfer_id",
)
def stats_with_timings(spark, sf_dir):
    stats, timings = d.run_stats(spark, sf_dir), d.server_timings(spark, sf_dir)
    return stats.join(timings, stats["date"] == timings["transfer_id"]).select(
        "date", "transfer_id", "compression", "read_par", "read_throughput_pb", "total_time"
    )


@query(
    "joi2_timings_of_matching_runs",
    BOTH + f"SELECT * FROM client_timings WHERE transfer_id IN (SELECT date FROM run_stats WHERE {PAR_ONE_SQL})",
)
def timings_of_matching_runs(spark, sf_dir):
    stats, timings = d.run_stats(spark, sf_dir), d.client_timings(spark, sf_dir)
    runs = stats.filter(select.all_equal(select.columns_like(stats, "_par"), 1))
    return timings.join(runs, timings["transfer_id"] == runs["date"], "left_semi")


@query(
    "joi3_append_unseen",
    f"WITH {d.SERVER_SQL}, {d.CLIENT_SQL} SELECT transfer_id, total_time FROM client_timings WHERE transfer_id NOT IN "
    "(SELECT transfer_id FROM server_timings)",
)
def append_unseen_ids(spark, sf_dir):
    batch = d.client_timings(spark, sf_dir).select("transfer_id", "total_time")
    return dedup.append_new(d.server_timings(spark, sf_dir), batch, "transfer_id")


_MEANS_SQL = ", ".join(
    [f"(SELECT avg({s}_throughput_pb) FROM server_timings) AS server_{s}_throughput_pb" for s in SERVER_STAGES]
    + [f"(SELECT avg({s}_throughput_pb) FROM client_timings) AS client_{s}_throughput_pb" for s in CLIENT_STAGES]
)


@query("joi4_side_by_side_means", f"WITH {d.SERVER_SQL}, {d.CLIENT_SQL} SELECT {_MEANS_SQL}")
def side_by_side(spark, sf_dir):
    server, client = d.server_timings(spark, sf_dir), d.client_timings(spark, sf_dir)
    left = select.prefixed(server, select.columns_like(server, "throughput_pb"), "server_")
    right = select.prefixed(client, select.columns_like(client, "throughput_pb"), "client_")
    return summarize.side_by_side_means(left, right, [*left.columns, *right.columns])


_CEILINGS_SQL = ", ".join(f"('{t}', '{s}', {m}, {r}.0, {w}.0)" for t, s, m, r, w in CEILINGS)
ALL_CEILINGS_SQL = (
    f"all_ceilings AS (SELECT target_system, source_system, mode, CAST(r AS DOUBLE) AS read_ceiling, "
    f"CAST(w AS DOUBLE) AS write_ceiling FROM (VALUES {_CEILINGS_SQL}) t(target_system, source_system, mode, r, w))"
)
CEILINGS_SQL = ALL_CEILINGS_SQL + f", ceilings AS (SELECT * EXCLUDE (mode) FROM all_ceilings WHERE mode = {STORAGE_MODE})"
_SIZES = {"lineitem_sf10": 10473, "ss13husallm": 10935, "iotm": 3667}
_SIZES_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _SIZES.items())


@query(
    "joi5_dimension_lookup",
    STATS + f", {ALL_CEILINGS_SQL} SELECT s.date, s.source_system, s.target_system, m.mode, "
    f'(CASE s."table" {_SIZES_SQL} END)::DOUBLE AS size, c.read_ceiling, c.write_ceiling '
    "FROM run_stats s CROSS JOIN (VALUES (1), (2)) m(mode) LEFT JOIN all_ceilings c ON s.source_system = c.source_system "
    "AND s.target_system = c.target_system AND m.mode = c.mode",
)
def dimension_lookup(spark, sf_dir):
    """Every run under both modes; combinations without ceilings, and tables without a size, get nulls."""
    runs = d.run_stats(spark, sf_dir).withColumn("mode", F.explode(F.array(F.lit(1), F.lit(2))))
    return with_ceilings(runs).select(
        "date", "source_system", "target_system", "mode", lookup(F.col("table"), _SIZES).cast("double").alias("size"),
        "read_ceiling", "write_ceiling",
    )


_KNOWN = sorted({(t, s) for t, s, m, _, _ in CEILINGS if m == STORAGE_MODE})
_KNOWN_SQL = " OR ".join(f"(target_system = '{t}' AND source_system = '{s}')" for t, s in _KNOWN)
_ALL_SIZES = {**_SIZES, "inputeventsm": 3601}


@query(
    "joi5_strict_lookup",
    STATS + f", {CEILINGS_SQL} SELECT s.date, (CASE s.\"table\" {' '.join(f'WHEN {k!r} THEN {v}' for k, v in _ALL_SIZES.items())} "
    "END)::DOUBLE AS size, c.read_ceiling, c.write_ceiling FROM run_stats s JOIN ceilings c USING (source_system, target_system)",
)
def strict_dimension_lookup(spark, sf_dir):
    """Runs whose systems have ceilings; one without them, or a table without a size, would fail the job."""
    runs = d.run_stats(spark, sf_dir).filter(F.expr(_KNOWN_SQL))
    size = strict_lookup(F.col("table"), _ALL_SIZES).cast("double")
    return with_ceilings(runs, strict=True).select("date", size.alias("size"), "read_ceiling", "write_ceiling")


# --- aggregates -------------------------------------------------------------------------------

_LONG_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS component, s.{s}_par AS parallelism, t.{s}_throughput_pb AS throughput, s.date "
    f"FROM run_stats s JOIN {'server' if s in SERVER_STAGES else 'client'}_timings t ON s.date = t.transfer_id "
    "WHERE {where}"
    for s in STAGES
)


def _long(spark, sf_dir, where=None):
    """Runs with their timings, one row per stage; each log is joined once."""
    stats = d.run_stats(spark, sf_dir)
    if where is not None:
        stats = stats.filter(where)

    def side(timings, stages):
        joined = stats.join(timings, stats["date"] == timings["transfer_id"])
        return slices.stages_to_long(joined, ["date"], stages)

    return side(d.server_timings(spark, sf_dir), SERVER_STAGES).unionByName(
        side(d.client_timings(spark, sf_dir), CLIENT_STAGES)
    )


@query("fn1_stages_to_long", BOTH + _LONG_SQL.replace("{where}", ONE_SQL))
def stages_long(spark, sf_dir):
    return _long(spark, sf_dir, select.matches(ONE_ENVIRONMENT)).select(
        "component", "parallelism", "throughput", "date"
    )


@query(
    "set2_stacked_timings",
    f"WITH {d.SERVER_SQL}, {d.CLIENT_SQL} SELECT transfer_id, total_time, 'server' AS side FROM server_timings "
    "UNION ALL SELECT transfer_id, total_time, 'client' FROM client_timings",
)
def stacked_timings(spark, sf_dir):
    server = d.server_timings(spark, sf_dir).select("transfer_id", "total_time", F.lit("server").alias("side"))
    client = d.client_timings(spark, sf_dir).select("transfer_id", "total_time", F.lit("client").alias("side"))
    return server.unionByName(client)


@query(
    "agg5_parallel_throughput",
    BOTH + f", long AS ({_LONG_SQL.replace('{where}', 'true')}) SELECT component, parallelism, avg(throughput) "
    "AS throughput, parallelism * avg(throughput) AS overall_throughput FROM long GROUP BY 1, 2",
)
def parallel_throughput(spark, sf_dir):
    return summarize.parallel_throughput(_long(spark, sf_dir))


_FRACTIONS_SQL = (
    f", long AS ({_LONG_SQL.replace('{where}', 'true')}), "
    "g AS (SELECT component, parallelism, avg(throughput) AS throughput, parallelism * avg(throughput) "
    "AS overall_throughput FROM long GROUP BY 1, 2), "
    "b AS (SELECT component, throughput AS base_throughput FROM g WHERE parallelism = 1) "
)


@query(
    "joi7_baseline_of_component",
    BOTH + _FRACTIONS_SQL + "SELECT g.*, b.base_throughput FROM g LEFT JOIN b USING (component)",
)
def baseline_of_component(spark, sf_dir):
    return summarize.serial_fractions(_long(spark, sf_dir)).drop("s")


@query(
    "fn9_serial_fractions",
    BOTH + _FRACTIONS_SQL + "SELECT g.component, g.parallelism, round(CASE WHEN parallelism = 1 THEN 0.0 ELSE "
    "greatest(0.0, least(1.0, (base_throughput * parallelism - overall_throughput) / "
    "(base_throughput * (parallelism - 1)))) END, 9) AS s FROM g LEFT JOIN b USING (component)",
)
def serial_fractions(spark, sf_dir):
    return summarize.serial_fractions(_long(spark, sf_dir)).select(
        "component", "parallelism", F.round("s", 9).alias("s")
    )


@query(
    "agg8_weighted_throughput",
    BOTH + f", long AS ({_LONG_SQL.replace('{where}', 'true')}) SELECT component, sum(throughput * parallelism) / "
    "count(*) AS throughput FROM long WHERE component IN ('read', 'send', 'rcv', 'write') GROUP BY 1",
)
def weighted_throughput(spark, sf_dir):
    return summarize.weighted_throughput(_long(spark, sf_dir), ["read", "send", "rcv", "write"])


@query(
    "agg6_column_means",
    f"WITH {d.SERVER_SQL} SELECT "
    + ", ".join(f"avg(nullif({s}_throughput_pb, 0)) AS {s}_throughput_pb"
                for s in SERVER_STAGES)
    + " FROM server_timings",
)
def column_means(spark, sf_dir):
    """A stage that moved nothing has no rate, so that null skipping shows."""
    df = d.server_timings(spark, sf_dir)
    names = select.columns_like(df, "throughput_pb")
    holes = df.select(*[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in names])
    return summarize.column_means(holes, names)


RATIOS_SQL = ", ".join(
    "1.0 AS nocomp_ratio"
    if c == "nocomp"
    else f"CASE WHEN avg(datasize) FILTER (compression = 'nocomp') > 0 THEN avg(datasize) FILTER "
    f"(compression = '{c}') / avg(datasize) FILTER (compression = 'nocomp') ELSE 0.0 END AS {c}_ratio"
    for c in CODECS
)


@query(
    "agg7_compression_ratios",
    STATS + f'SELECT buffer_size, "table", {RATIOS_SQL} FROM run_stats GROUP BY 1, 2',
)
def compression_ratios(spark, sf_dir):
    return summarize.compression_ratios(d.run_stats(spark, sf_dir), ["buffer_size", "table"], CODECS)


_ENVIRONMENT, _SYSTEMS = ["server_cpu", "client_cpu", "network"], ["source_system", "target_system"]


@query(
    "agg13_distinct_pairs",
    STATS + "SELECT server_cpu, client_cpu, network, string_agg(p, ';' ORDER BY p) AS pairs FROM (SELECT DISTINCT "
    "server_cpu, client_cpu, network, concat(source_system, '>', target_system) AS p FROM run_stats) GROUP BY 1, 2, 3",
)
def distinct_pairs(spark, sf_dir):
    """Per environment the set of its pairs of systems."""
    sets = summarize.pair_sets(d.run_stats(spark, sf_dir), _ENVIRONMENT, _SYSTEMS)
    shown = F.transform("pairs", lambda p: F.concat(p["source_system"], F.lit(">"), p["target_system"]))
    return sets.withColumn("pairs", F.array_join(shown, ";"))


@query(
    "agg13_pair_rows",
    STATS + "SELECT DISTINCT server_cpu, client_cpu, network, source_system, target_system FROM run_stats",
)
def pair_rows(spark, sf_dir):
    """The same sets as rows."""
    return summarize.distinct_pairs(d.run_stats(spark, sf_dir), _ENVIRONMENT, _SYSTEMS)


# --- single stages and records ----------------------------------------------------------------

_ORDER_SQL = " UNION ALL ".join(
    f"SELECT transfer_id, {i} AS ord, '{s}' AS stage, {s}_throughput_pb AS rate FROM server_timings"
    for i, s in enumerate(SERVER_STAGES)
)


@query(
    "srt5_nth_slowest_stage",
    f"WITH {d.SERVER_SQL}, stages AS ({_ORDER_SQL}), ranked AS (SELECT *, row_number() OVER (PARTITION BY transfer_id "
    "ORDER BY rate, ord) AS rn FROM stages WHERE rate <> 0) SELECT t.transfer_id, r.stage, r.rate FROM "
    "server_timings t LEFT JOIN ranked r ON t.transfer_id = r.transfer_id AND r.rn = 4",
)
def nth_slowest_stage(spark, sf_dir):
    df = d.server_timings(spark, sf_dir)
    df = df.select("transfer_id", *[F.col(f"{s}_throughput_pb").alias(s) for s in SERVER_STAGES])
    found = df.withColumn("_s", ranking.nth_slowest(SERVER_STAGES, 3))
    return found.select("transfer_id", "_s.stage", "_s.rate")


@query(
    "srt7_latest_record",
    f"WITH {d.CLIENT_SQL} SELECT transfer_id, CAST(22 AS INTEGER) AS n_fields FROM client_timings "
    "ORDER BY transfer_id DESC LIMIT 1",
)
def latest_record(spark, sf_dir):
    df = d.client_timings(spark, sf_dir)
    lines = df.select(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns]).alias("value"))
    return ranking.latest_record(lines).select("transfer_id", F.size("fields").alias("n_fields"))


@query(
    "met11_counter_delta",
    STATS + "SELECT host, run, max(datasize) - min(datasize) AS moved FROM run_stats GROUP BY 1, 2",
)
def counter_delta(spark, sf_dir):
    return summarize.counter_delta(d.run_stats(spark, sf_dir), ["host", "run"], "datasize")


@query(
    "met12_normalised_cpu",
    STATS + "SELECT date, round_even(avg_cpu_server / (server_cpu * 100) * 100, 2) AS avg_cpu_server FROM run_stats",
)
def normalised_cpu(spark, sf_dir):
    from ..functions.rates import normalised_cpu as normalised

    return d.run_stats(spark, sf_dir).select(
        "date", normalised(F.col("avg_cpu_server"), F.col("server_cpu")).alias("avg_cpu_server")
    )


@query(
    "agg11_average_cpu",
    "SELECT user_id % 7 AS host, coalesce(sum(CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) "
    "/ 64.0 END), 0) / count(*) AS average_cpu, count(*) AS samples FROM events GROUP BY 1",
)
def average_cpu(spark, sf_dir):
    """Samples as text; those of error events are not readable."""
    sample = F.when(F.col("event_type") == "error", "--").otherwise(
        F.round(F.col("value") * 100).cast("bigint").cast("double").__truediv__(64.0).cast("decimal(20,6)").cast("string")
    )
    samples = d.table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("host"), sample.alias("cpu"))
    return summarize.average_cpu(samples, ["host"], "cpu")


@query(
    "agg12_estimation_error",
    STATS + ", est AS (SELECT compression, datasize / 1000000.0 / time AS estimated, "
    "avg_cpu_server + 1 AS real FROM run_stats) SELECT compression, round(avg(abs(estimated - real) / real * 100), 6) "
    "AS mape, round(sqrt(avg((real - estimated) * (real - estimated))), 6) AS rmse FROM est GROUP BY 1",
)
def estimation_error(spark, sf_dir):
    runs = d.run_stats(spark, sf_dir).select(
        "compression",
        (F.col("datasize") / 1000000.0 / F.col("time")).alias("estimated"),
        (F.col("avg_cpu_server") + 1).alias("real"),
    )
    errors = summarize.estimation_error(runs, ["compression"])
    return errors.select("compression", F.round("mape", 6).alias("mape"), F.round("rmse", 6).alias("rmse"))


@query(
    "fn10_real_throughput",
    "WITH r AS (SELECT o_orderkey, CASE o_custkey % 6 WHEN 0 THEN 3667 WHEN 1 THEN 10935 WHEN 2 THEN 3601 ELSE 10473 END "
    "AS size, CAST(ROUND(o_totalprice * 100) AS BIGINT) // 1000 / 64.0 AS runtime, 1.0 + o_custkey AS estimated FROM orders) "
    "SELECT o_orderkey, CAST(size AS DOUBLE) AS size, round(size / runtime, 8) AS real, "
    "round(abs(estimated - size / runtime), 8) AS difference, "
    "round(abs(estimated - size / runtime) / (size / runtime) * 100, 6) AS percentage_error FROM r",
)
def real_throughput(spark, sf_dir):
    from ..plans.report import predicted_vs_actual

    names = list(ENVIRONMENT_SIZES)
    runs = d.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr(d.pick("o_custkey % 6", *names)).alias("env_name"),
        F.expr(f"({d.CENTS} div 1000) / 64.0D").alias("runtime"),
        F.expr("1.0D + o_custkey").alias("estimated"),
    )
    report = predicted_vs_actual(runs, ENVIRONMENT_SIZES)
    return report.select(
        "o_orderkey",
        "size",
        F.round("real", 8).alias("real"),
        F.round("difference", 8).alias("difference"),
        F.round("percentage_error", 6).alias("percentage_error"),
    )


@query(
    "fn13_control_messages",
    f"WITH {d.MESSAGES_SQL}, p AS (SELECT o_orderkey, CASE WHEN json_valid(message) THEN message END AS m "
    "FROM control_messages), f AS (SELECT o_orderkey, m ->> '$.operation' AS operation, "
    "TRY_CAST(m ->> '$.payload.writeParallelism' AS DOUBLE) AS write_par, "
    "TRY_CAST(m ->> '$.payload.decompParallelism' AS DOUBLE) AS decomp_par, "
    "TRY_CAST(m ->> '$.payload.serParallelism' AS DOUBLE) AS ser_par FROM p) "
    "SELECT *, CASE WHEN operation IS NULL THEN 'invalid' WHEN operation NOT IN ('start_transfer', 'acknowledged', "
    "'get_environment', 'set_environment', 'transfer_finished') THEN 'unexpected' WHEN operation = 'set_environment' "
    "AND (write_par IS NULL OR decomp_par IS NULL OR ser_par IS NULL) THEN 'invalid' ELSE 'ok' END AS status FROM f",
)
def control_messages(spark, sf_dir):
    from ..functions.messages import parse_messages

    parsed = parse_messages(d.control_messages(spark, sf_dir)).drop("message")
    return parsed.withColumns({c: F.col(c).cast("double") for c in ("write_par", "decomp_par", "ser_par")})
