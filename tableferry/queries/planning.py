"""Transfer settings from the run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import CODECS, ENVIRONMENT_SIZES, STAGES
from ..functions.rates import effective_rate
from ..operators import slices, summarize
from ..plans import base_rates as base
from ..plans import calibration, report, rules, search
from . import derived as d
from .registry import query
from .runlogs import CEILINGS_SQL, PAR_ONE_SQL, RATIOS_SQL

KEYS = base.ENVIRONMENT + base.SETTING
KEYS_SQL = ", ".join(f'"{k}"' for k in KEYS)
ENV_SQL = ", ".join(f'"{k}"' for k in base.ENVIRONMENT)
_RATE = {s: f"{s}_throughput_pb" for s in STAGES}
_MEANS = ", ".join(f"avg({c}) AS {s}" for s, c in _RATE.items())

RATES_SQL = (
    f"{d.RUN_STATS_SQL}, {d.SERVER_SQL}, {d.CLIENT_SQL}, runs AS (SELECT DISTINCT date, {KEYS_SQL} FROM run_stats "
    f"WHERE {PAR_ONE_SQL}), "
    f"s AS (SELECT {KEYS_SQL}, " + ", ".join(f"avg({_RATE[x]}) AS {x}" for x in STAGES[:4])
    + f" FROM runs JOIN server_timings ON date = transfer_id GROUP BY {KEYS_SQL}), "
    f"c AS (SELECT {KEYS_SQL}, " + ", ".join(f"avg({_RATE[x]}) AS {x}" for x in STAGES[4:])
    + f" FROM runs JOIN client_timings ON date = transfer_id GROUP BY {KEYS_SQL}), "
    f"base_rates AS (SELECT {KEYS_SQL}, read, deser, comp, greatest(send, rcv) AS send, greatest(send, rcv) AS rcv, "
    f"decomp, ser, write FROM s FULL JOIN c USING ({KEYS_SQL}))"
)
WITH_RATES = f"WITH {RATES_SQL} "


def _rates(spark, sf_dir):
    return base.base_rates(d.run_stats(spark, sf_dir), d.server_timings(spark, sf_dir), d.client_timings(spark, sf_dir))


@query("pln1_base_rates", WITH_RATES + f"SELECT {KEYS_SQL}, {', '.join(STAGES)} FROM base_rates")
def base_rates(spark, sf_dir):
    return _rates(spark, sf_dir)


@query(
    "fn11_network_rate",
    f"WITH {d.SERVER_SQL}, {d.CLIENT_SQL} SELECT s.transfer_id, greatest(send_throughput_pb, rcv_throughput_pb) AS send, "
    "greatest(send_throughput_pb, rcv_throughput_pb) AS rcv FROM server_timings s JOIN client_timings c USING (transfer_id)",
)
def network_rate(spark, sf_dir):
    server = d.server_timings(spark, sf_dir).select("transfer_id", "send_throughput_pb")
    client = d.client_timings(spark, sf_dir).select("transfer_id", "rcv_throughput_pb")
    rate = F.greatest("send_throughput_pb", "rcv_throughput_pb")
    return server.join(client, "transfer_id").select("transfer_id", rate.alias("send"), rate.alias("rcv"))


@query(
    "pln2_effective_rates",
    WITH_RATES + f"SELECT {KEYS_SQL}, w.workers, round((0.3 + 0.7 * w.workers) * read, 9) AS rate FROM base_rates, "
    "(VALUES (1), (2), (4), (8), (16)) w(workers)",
)
def effective_rates(spark, sf_dir):
    grid = slices.with_grid(_rates(spark, sf_dir), {"workers": [1, 2, 4, 8, 16]})
    return grid.select(*KEYS, "workers", F.round(effective_rate(F.col("read"), F.col("workers")), 9).alias("rate"))


_RATE_COLUMNS = ", ".join(f"(0.3 + (1 - 0.3) * r.{s}_par) * b.{s} AS {s}_rate" for s in STAGES)


@query(
    "pln3_config_throughput",
    WITH_RATES + f", rated AS (SELECT r.date, {_RATE_COLUMNS} FROM run_stats r JOIN base_rates b USING ({KEYS_SQL})) "
    "SELECT date, round(read_rate, 9) AS read_rate, round(comp_rate, 9) AS comp_rate, round(least("
    + ", ".join(f"nullif({s}_rate, 0)" for s in STAGES)
    + "), 9) AS throughput FROM rated",
)
def config_throughput(spark, sf_dir):
    """Every recorded configuration judged with the base rates of its environment, codec and skip flag."""
    runs = d.run_stats(spark, sf_dir).select("date", *KEYS, *[f"{s}_par" for s in STAGES])
    judged = rules.config_throughput(runs.join(_rates(spark, sf_dir), list(KEYS)))
    return judged.select("date", *[F.round(c, 9).alias(c) for c in ("read_rate", "comp_rate", "throughput")])


_RATIO_OF_CODEC = "CASE compression " + " ".join(f"WHEN '{c}' THEN {c}_ratio" for c in CODECS) + " END"
BOUNDS_SQL = (
    f"{RATES_SQL}, {CEILINGS_SQL}, ratios AS (SELECT \"table\", {RATIOS_SQL} FROM run_stats WHERE buffer_size = 1024 "
    "GROUP BY 1), net AS (SELECT b.*, c.read_ceiling, c.write_ceiling, "
    f"{_RATIO_OF_CODEC} AS ratio, CASE WHEN network = 0 THEN 10000.0 ELSE network END AS net FROM base_rates b "
    'LEFT JOIN ratios USING ("table") LEFT JOIN ceilings c ON b.source_system = c.source_system AND '
    "b.target_system = c.target_system), "
    "storage AS (SELECT *, CASE WHEN read_ceiling IS NOT NULL AND write_ceiling IS NOT NULL THEN "
    "least(read_ceiling, write_ceiling) END AS storage FROM net), "
    f"bounds AS (SELECT {KEYS_SQL}, {', '.join(STAGES)}, CASE WHEN net < storage THEN CASE WHEN compression = 'nocomp' "
    "THEN net ELSE net / nullif(ratio, 0) END ELSE storage END AS bound, "
    "CAST(floor(server_cpu * 1.2) AS INTEGER) AS server_cap, CAST(floor(client_cpu * 1.2) AS INTEGER) AS client_cap "
    "FROM storage)"
)


def _bounded(spark, sf_dir):
    """Base rates with bound and worker caps of every environment, codec and skip flag."""
    stats = d.run_stats(spark, sf_dir)
    measured = stats.filter(F.col("buffer_size") == 1024)
    ratios = summarize.compression_ratios(measured, ["table"], CODECS)
    rated = rules.with_ceilings(_rates(spark, sf_dir)).join(ratios, "table", "left")
    ratio = F.coalesce(*[F.when(F.col("compression") == c, F.col(f"{c}_ratio")) for c in CODECS])
    bound = rules.throughput_bound(
        F.col("read_ceiling"), F.col("write_ceiling"), F.col("network"), F.col("compression"), ratio
    )
    return rated.select(
        *KEYS,
        *STAGES,
        bound.alias("bound"),
        rules.worker_cap(F.col("server_cpu")).alias("server_cap"),
        rules.worker_cap(F.col("client_cpu")).alias("client_cap"),
    )


@query(
    "pln5_throughput_bounds",
    f"WITH {BOUNDS_SQL} SELECT {KEYS_SQL}, round(bound, 6) AS bound, server_cap, client_cap FROM bounds",
)
def throughput_bounds(spark, sf_dir):
    return _bounded(spark, sf_dir).select(*KEYS, F.round("bound", 6).alias("bound"), "server_cap", "client_cap")


def _r(stage: str, workers: str) -> str:
    return f"nullif((0.3::DOUBLE + (1 - 0.3::DOUBLE) * {workers}) * {stage}, 0)"


KNOWN_SQL = " AND ".join(f"{s} IS NOT NULL" for s in STAGES)

# Every combination is tried here, which is what the closed form must equal.
GRID_SQL = (
    f"WITH {BOUNDS_SQL}, tried AS (SELECT {ENV_SQL}, compression, bound, r.w AS read_par, de.w AS deser_par, "
    "co.w AS comp_par, dc.w AS decomp_par, se.w AS ser_par, "
    f"least({_r('read', 'r.w')}, {_r('deser', 'de.w')}, {_r('comp', 'co.w')}, {_r('send', '1')}, {_r('rcv', '1')}, "
    f"{_r('decomp', 'dc.w')}, {_r('ser', 'se.w')}, {_r('write', '1')}) AS throughput FROM bounds, "
    "range(1, 20) r(w), range(1, 20) de(w), range(1, 20) co(w), range(1, 20) dc(w), range(1, 20) se(w) "
    f"WHERE {KNOWN_SQL} AND skip_ser = 0 AND r.w + de.w + co.w + 1 <= server_cap AND dc.w + se.w + 1 <= client_cap) "
    f"SELECT {ENV_SQL}, compression, round(throughput, 9) AS throughput, read_par, deser_par, comp_par, decomp_par, ser_par "
    f"FROM tried WHERE throughput <= bound QUALIFY row_number() OVER (PARTITION BY {ENV_SQL} ORDER BY throughput DESC, "
    "list_position(['nocomp', 'zstd', 'lz4', 'lzo', 'snappy'], compression), read_par, deser_par, comp_par, decomp_par, "
    "ser_par) = 1"
)


@query("pln4_grid_search", GRID_SQL)
def grid_search(spark, sf_dir):
    found = search.grid_search(_bounded(spark, sf_dir).filter(F.col("skip_ser") == 0), base.ENVIRONMENT)
    return found.withColumn("throughput", F.round("throughput", 9))


_STEPS_SQL = " UNION ALL ".join(
    f"SELECT {KEYS_SQL}, bound, server_cap, client_cap, {i} AS ord, {int(i < 4)} AS server, w, "
    f"(0.3::DOUBLE + (1 - 0.3::DOUBLE) * w) * {s} AS rate FROM bounds, range(1, 20) t(w) WHERE {s} > 0"
    for i, s in enumerate(STAGES)
)
ALLOCATION_SQL = (
    f"WITH {BOUNDS_SQL}, steps AS ({_STEPS_SQL}), used AS (SELECT *, "
    "4 + coalesce(sum(server) OVER w, 0) AS server_used, 4 + coalesce(sum(1 - server) OVER w, 0) AS client_used "
    f"FROM steps WINDOW w AS (PARTITION BY {KEYS_SQL} ORDER BY rate, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    f"given AS (SELECT {KEYS_SQL}, ord, count(*) AS n FROM used WHERE rate < bound AND server_used < server_cap AND "
    f"client_used < client_cap GROUP BY {KEYS_SQL}, ord) "
    f"SELECT {', '.join('b.' + chr(34) + k + chr(34) for k in KEYS)}, "
    + ", ".join(f"CASE WHEN max(b.bound) IS NOT NULL THEN CAST(1 + coalesce(max(n) FILTER (ord = {i}), 0) AS INTEGER) END AS {s}_par"
                for i, s in enumerate(STAGES))
    + f" FROM bounds b LEFT JOIN given g ON "
    + " AND ".join(f'b."{k}" = g."{k}"' for k in KEYS)
    + f" GROUP BY {', '.join('b.' + chr(34) + k + chr(34) for k in KEYS)}"
)


@query("pln6_worker_allocation", ALLOCATION_SQL)
def worker_allocation(spark, sf_dir):
    return search.allocate_workers(_bounded(spark, sf_dir)).select(*KEYS, *[f"{s}_par" for s in STAGES])


_SAME_SQL = "(source_system = target_system AND target_system IN ('csv', 'parquet'))"


@query(
    "pln8_layout_rules",
    f"WITH {d.RUN_STATS_SQL}, f AS (SELECT *, 1 AS source_format, CASE target_system WHEN 'pandas' THEN 2 ELSE 1 END AS "
    "target_format FROM run_stats) SELECT date, CAST(CASE WHEN target_system = 'postgres' THEN 1 WHEN target_format = 2 OR "
    "compression <> 'nocomp' THEN 2 ELSE 1 END AS INTEGER) AS format, "
    f"CAST({_SAME_SQL} AS INTEGER) AS skip_ser, CASE WHEN {_SAME_SQL} THEN read_par ELSE deser_par END AS deser_par, "
    f"CASE WHEN target_system = 'pandas' THEN write_par WHEN {_SAME_SQL} THEN decomp_par ELSE ser_par END AS ser_par, "
    "CASE WHEN target_system = 'pandas' THEN 1 ELSE send_par END AS send_par, "
    "CASE WHEN target_system IN ('spark', 'postgres') THEN 1 ELSE write_par END AS write_par FROM f",
)
def layout_rules(spark, sf_dir):
    runs = d.run_stats(spark, sf_dir).withColumns(
        {"source_format": F.lit(1), "target_format": F.when(F.col("target_system") == "pandas", 2).otherwise(1)}
    )
    return rules.layout_rules(runs).select(
        "date", "format", "skip_ser", "deser_par", "ser_par", "send_par", "write_par"
    )


_NAMES = list(ENVIRONMENT_SIZES)
_ENV_NAME_SQL = d.pick("o_custkey % 7", *_NAMES, "unknown")
_SIZE_SQL = "CASE env_name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ENVIRONMENT_SIZES.items()) + " END"


_LEAST_SQL = "least(" + ", ".join(f"nullif({s}_rate, 0)" for s in STAGES) + ")"


@query(
    "pln10_predicted_vs_actual",
    WITH_RATES + f", rated AS (SELECT r.date, {_RATE_COLUMNS} FROM run_stats r JOIN base_rates b USING ({KEYS_SQL})), "
    f"r AS (SELECT {_ENV_NAME_SQL} AS env_name, o_orderpriority AS optimizer, CAST(ROUND(o_totalprice * 100) AS BIGINT) "
    f"// 1000 / 64.0 AS runtime, {_LEAST_SQL} AS estimated FROM orders JOIN rated ON o_orderkey = date), "
    f"t AS (SELECT *, {_SIZE_SQL} / runtime AS real FROM r) SELECT env_name, optimizer, "
    "round(avg(abs(estimated - real) / real * 100), 6) AS mape, round(sqrt(avg((real - estimated) ** 2)), 6) AS rmse "
    "FROM t GROUP BY 1, 2",
)
def predicted_vs_actual(spark, sf_dir):
    """The throughput that the base rates promise for each recorded configuration, against what its run time says."""
    runs = d.run_stats(spark, sf_dir).select("date", *KEYS, *[f"{s}_par" for s in STAGES])
    promised = rules.config_throughput(runs.join(_rates(spark, sf_dir), list(KEYS))).select("date", "throughput")
    orders = d.table(spark, sf_dir, "orders")
    measured = orders.join(promised, orders["o_orderkey"] == promised["date"]).select(
        F.expr(_ENV_NAME_SQL).alias("env_name"),
        F.col("o_orderpriority").alias("optimizer"),
        F.expr(f"({d.CENTS} div 1000) / 64.0D").alias("runtime"),
        F.col("throughput").alias("estimated"),
    )
    errors = report.optimizer_report(measured, ENVIRONMENT_SIZES, ["env_name", "optimizer"])
    return errors.withColumns({"mape": F.round("mape", 6), "rmse": F.round("rmse", 6)})


# Environments to calibrate: one per supplier.
_CALIBRATED = {
    "name": "s_name",
    "active": "CASE WHEN s_suppkey % 4 = 3 THEN 0 ELSE 1 END",
    "source_system": d.pick("s_suppkey % 3", "csv", "parquet", "postgres"),
    "target_system": d.pick("(s_suppkey div 3) % 4", "csv", "parquet", "pandas", "spark"),
    "source_format": "1",
    "target_format": "1 + (s_suppkey div 12) % 2",
}
_CALIBRATED_SQL = ", ".join(f'{v.replace(" div ", " // ")} AS {k}' for k, v in _CALIBRATED.items())


@query(
    "pln11_calibration_plan",
    f"WITH e AS (SELECT {_CALIBRATED_SQL}, CASE WHEN s_suppkey % 2 = 0 THEN ['lineitem_sf10', 'iotm'] ELSE ['ss13husallm'] "
    "END AS tables FROM supplier), r AS (SELECT e.*, unnest(tables) AS \"table\" FROM e WHERE active = 1), "
    "x AS (SELECT r.*, c.compression FROM r, (VALUES ('nocomp'), ('zstd'), ('lz4'), ('lzo'), ('snappy')) c(compression)) "
    "SELECT name, source_system, target_system, \"table\", compression, CAST(CASE WHEN compression <> 'nocomp' OR "
    "target_system = 'pandas' OR source_format = 2 OR target_format = 2 THEN 2 ELSE 1 END AS INTEGER) AS format, "
    "CASE WHEN source_system = 'parquet' THEN 65536 ELSE 1024 END AS buffer_size, "
    "CASE WHEN source_system = 'parquet' THEN 65536 ELSE 1024 END * 12 AS bufferpool_size, k.skip_ser "
    f"FROM x, (VALUES (0), (1)) k(skip_ser) WHERE k.skip_ser = 0 OR {_SAME_SQL}",
)
def calibration_plan(spark, sf_dir):
    environments = d.table(spark, sf_dir, "supplier").select(
        *[F.expr(v).alias(k) for k, v in _CALIBRATED.items()],
        F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("lineitem_sf10"), F.lit("iotm")))
        .otherwise(F.array(F.lit("ss13husallm")))
        .alias("tables"),
    )
    return calibration.calibration_plan(environments)


SWEPT = (1, 2, 4, 8, 16)


@query(
    "pln11_sweep_grid",
    "WITH g AS (SELECT s_suppkey, c.compression, r.w * d.w * m.w AS server, o.w * s.w * t.w AS client, "
    "(r.w + d.w + m.w + 1 + 4) * 3072 AS server_pool, (o.w + s.w + t.w + 1 + 4) * 3072 AS client_pool FROM supplier, "
    "(VALUES ('nocomp'), ('zstd'), ('lz4'), ('lzo'), ('snappy')) c(compression), "
    + ", ".join(f"(VALUES {', '.join(f'({w})' for w in SWEPT)}) {a}(w)" for a in "rdmost")
    + ") SELECT s_suppkey, compression, count(*) AS configurations, CAST(sum(server * client) AS BIGINT) AS products, "
    "CAST(sum(server_pool * client) AS BIGINT) AS server_pools, CAST(sum(client_pool * server) AS BIGINT) AS client_pools, "
    "CAST(max(server_pool) AS INTEGER) AS largest_pool FROM g GROUP BY 1, 2",
)
def sweep_grid(spark, sf_dir):
    """All 78,125 settings of every supplier's environment; what is compared are sums over them."""
    grid = calibration.sweep_grid(d.table(spark, sf_dir, "supplier").select("s_suppkey"), SWEPT)
    server = (F.col("read_par") * F.col("deser_par") * F.col("comp_par") * F.col("send_par")).cast("bigint")
    client = (F.col("rcv_par") * F.col("decomp_par") * F.col("ser_par") * F.col("write_par")).cast("bigint")
    return grid.groupBy("s_suppkey", "compression").agg(
        F.count("*").alias("configurations"),
        F.sum(server * client).alias("products"),
        F.sum(F.col("server_buffpool_size") * client).alias("server_pools"),
        F.sum(F.col("client_buffpool_size") * server).alias("client_pools"),
        F.max("server_buffpool_size").alias("largest_pool"),
    )


@query(
    "joi6_parameter_product",
    "SELECT c_custkey, f.format, b.buff_size, w.workers FROM customer, (VALUES (1), (2)) f(format), "
    "(VALUES (64), (256), (1024)) b(buff_size), range(1, 5) w(workers) WHERE w.workers <= 1 + c_custkey % 4",
)
def parameter_product(spark, sf_dir):
    """Lists may depend on the row: here the workers go up to the customer's own cap."""
    base_rows = d.table(spark, sf_dir, "customer").select("c_custkey")
    workers = F.sequence(F.lit(1), (1 + F.col("c_custkey") % 4).cast("int"))
    return slices.with_grid(base_rows, {"format": [1, 2], "buff_size": [64, 256, 1024], "workers": workers})


_SERVER = {"read_par": 10, "deser_par": 4, "send_par": 1, "rcv_par": 1, "buffer_size": 1024, "server_buffpool_size": 61440, "format": 2, "skip_ser": 0}
_AGGRESSIVE = {**_SERVER, "comp_par": 4, "decomp_par": 4, "ser_par": 8, "write_par": 8, "client_buffpool_size": 61440, "compression": "snappy"}
_CONSERVATIVE = {
    **_SERVER, "comp_par": 4, "decomp_par": 1, "ser_par": 1, "write_par": 1, "client_buffpool_size": 27648, "compression": "nocomp",
}
_UNCOMPRESSED = {**_SERVER, "comp_par": 1, "decomp_par": 1, "ser_par": 8, "write_par": 8, "client_buffpool_size": 61440, "compression": "nocomp"}
CPU_CONFIGS = {"aggressive": _AGGRESSIVE, "conservative": _CONSERVATIVE}
NETWORK_CONFIGS = {"comp": _AGGRESSIVE, "nocomp": _UNCOMPRESSED}
SETTINGS = sorted(_AGGRESSIVE)


def _configs_sql(configs) -> str:
    return ", ".join(f"('{n}', {', '.join(repr(c[k]) for k in SETTINGS)})" for n, c in configs.items())


@query(
    "pln12_sensitivity_grid",
    "SELECT s_suppkey, 'client_cpu' AS axis, u.cpu AS client_cpu, CAST(s_suppkey % 3 * 125 AS INTEGER) AS network, k.* "
    f"FROM supplier, (VALUES (1), (2), (4), (8), (16)) u(cpu), (VALUES {_configs_sql(CPU_CONFIGS)}) "
    f"k(config, {', '.join(SETTINGS)}) UNION ALL SELECT s_suppkey, 'network', 8, n.net, k.* FROM supplier, "
    f"(VALUES (125), (250), (500), (1000), (0)) n(net), (VALUES {_configs_sql(NETWORK_CONFIGS)}) "
    f"k(config, {', '.join(SETTINGS)})",
)
def sensitivity_grid(spark, sf_dir):
    bases = d.table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3 * 125).alias("network"))
    return calibration.sensitivity_grid(
        bases, [1, 2, 4, 8, 16], [125, 250, 500, 1000, 0], CPU_CONFIGS, NETWORK_CONFIGS
    ).select("s_suppkey", "axis", "client_cpu", "network", "config", *SETTINGS)
