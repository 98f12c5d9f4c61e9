"""The sweep log: cleaning, averages, pivots, slices and best configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import AVERAGED_COLUMNS, CODECS, CONFIG_COLUMNS, MEASURED_COLUMNS, OPTIMIZER_LABELS, OPTIMIZER_ORDER, TABLE_LABELS, TABLE_ORDER
from ..functions import labels, rates
from ..operators import dedup, ordering, ranking, select, selection, slices, summarize
from ..session import work_dir
from . import derived as d
from .registry import query

WITH = f"WITH {d.MEASUREMENTS_SQL} "
REST = [c for c in d.MEASUREMENTS if c not in CONFIG_COLUMNS]
CONFIG_SQL = ", ".join(f'"{c}"' for c in CONFIG_COLUMNS)
REST_SQL = ", ".join(f'"{c}"' for c in REST)
PARAMS = ("client_write_par", "client_decomp_par", "server_read_par", "server_deser_par", "server_comp_par")
LABELS_SQL = 'CASE "table" ' + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TABLE_LABELS.items()) + ' ELSE "table" END'
ALL_SQL = ", ".join(f'"{c}"' for c in d.MEASUREMENTS)


def _round(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- projections and filters ------------------------------------------------------------------


@query("prj3_cast_then_sort", WITH + "SELECT date, CAST(bufpool_size AS INTEGER) AS bufpool_size FROM measurements")
def cast_then_sort(spark, sf_dir):
    text = d.measurements(spark, sf_dir).select("date", F.col("bufpool_size").cast("string").alias("bufpool_size"))
    return text.withColumn("bufpool_size", F.col("bufpool_size").cast("int")).orderBy("bufpool_size", "date")


@query("flt4_equal_columns", WITH + "SELECT date, server_comp_par, time FROM measurements WHERE server_comp_par = client_decomp_par")
def equal_columns(spark, sf_dir):
    df = d.measurements(spark, sf_dir)
    return df.filter(F.col("server_comp_par") == F.col("client_decomp_par")).select("date", "server_comp_par", "time")


@query("flt5_ranges", WITH + "SELECT date, time, buff_size FROM measurements WHERE time > 3 AND buff_size <= 1024 AND system <> 'csv'")
def ranges(spark, sf_dir):
    df = d.measurements(spark, sf_dir)
    return df.filter((F.col("time") > 3) & (F.col("buff_size") <= 1024) & (F.col("system") != "csv")).select(
        "date", "time", "buff_size"
    )


@query("flt6_kept_and_rejected", WITH + "SELECT date, time, time > 3 AS kept FROM measurements")
def kept_and_rejected(spark, sf_dir):
    """Both sets are saved by one job, and read back from their folders."""
    rows = d.measurements(spark, sf_dir).select("date", "time")
    kept, rejected = select.save_split(rows, F.col("time") > 3, work_dir(spark, "split"))
    return kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False)))


# --- aggregates -------------------------------------------------------------------------------

_AVG_KEYS = ", ".join(f'"{c}"' for c in AVERAGED_COLUMNS)


@query(
    "agg2_mean_by_configuration",
    WITH + f"SELECT {_AVG_KEYS}, avg(time) AS time, avg(datasize) AS datasize FROM measurements "
    f"WHERE server_read_partitions = 1 GROUP BY {_AVG_KEYS}",
)
def mean_by_configuration(spark, sf_dir):
    means = summarize.mean_by(d.measurements(spark, sf_dir), AVERAGED_COLUMNS, ["time", "datasize"])
    return means.filter(F.col("server_read_partitions") == 1)


@query("agg3_fastest_by_pair", WITH + 'SELECT "table", system, min(time) AS time FROM measurements GROUP BY 1, 2')
def fastest_by_pair(spark, sf_dir):
    return summarize.mean_by(d.measurements(spark, sf_dir), ["table", "system"], ["time"], how="min")


@query(
    "agg4_table_by_system",
    WITH + ", m AS (SELECT " + LABELS_SQL + ' AS "table", system, time FROM measurements) SELECT t.name AS "table", '
    + ", ".join(
        f"coalesce((SELECT min(time) FROM m WHERE m.\"table\" = t.name AND system = '{s}'), 0) AS {s}"
        for s in ("csv", "postgres", "netcat")
    )
    + " FROM (VALUES ('lineitem'), ('acs'), ('iot'), ('icu'), ('unseen')) t(name)",
)
def table_by_system(spark, sf_dir):
    df = d.measurements(spark, sf_dir).withColumn("table", labels.relabel(F.col("table"), TABLE_LABELS))
    return summarize.pivot_table(
        df, "table", "system", "time", ["csv", "postgres", "netcat"], rows=[*TABLE_ORDER, "unseen"], how="min"
    )


@query(
    "agg9_mean_and_spread",
    WITH + "SELECT client_cpu, server_comp_par, round(avg(time), 6) AS time_mean, round(stddev_samp(time), 6) AS time_sd, "
    "count(time) AS n FROM measurements GROUP BY 1, 2",
)
def mean_and_spread(spark, sf_dir):
    spread = summarize.mean_and_spread(d.measurements(spark, sf_dir), ["client_cpu", "server_comp_par"], "time")
    return _round(spread, 6, "time_mean", "time_sd")


@query(
    "agg10_distribution",
    WITH + "SELECT compression, format, count(time) AS n, min(time) AS \"min\", round(quantile_cont(time, 0.25), 9) AS q25, "
    "round(quantile_cont(time, 0.5), 9) AS q50, round(quantile_cont(time, 0.75), 9) AS q75, max(time) AS \"max\" "
    "FROM measurements GROUP BY 1, 2",
)
def distribution(spark, sf_dir):
    spread = selection.quantiles(
        d.measurements(spark, sf_dir), ["compression", "format"], "time", {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    )
    return _round(spread, 9, "q25", "q50", "q75")


@query(
    "agg14_cleaning_counts",
    WITH + f", k AS (SELECT * FROM measurements WHERE time > 3), g AS (SELECT DISTINCT {CONFIG_SQL} FROM k) "
    "SELECT (SELECT count(*) FROM measurements) AS original, (SELECT count(*) FROM measurements WHERE NOT time > 3) "
    "AS rejected, (SELECT count(*) FROM k) - (SELECT count(*) FROM g) AS duplicates_removed, "
    "(SELECT count(*) FROM g) AS remaining",
)
def cleaning_counts(spark, sf_dir):
    return dedup.cleaning_counts(d.measurements(spark, sf_dir), F.col("time") > 3, CONFIG_COLUMNS)


@query(
    "agg15_data_size_report",
    WITH + "SELECT compression, CASE format WHEN 1 THEN 'row' ELSE 'col' END || '_' || buff_size AS format_buff, "
    "round(avg(datasize) * 1e-6, 9) AS megabytes, round(avg(datasize) / 1073741824, 9) AS gibibytes FROM measurements "
    "GROUP BY 1, 2",
)
def data_size_report(spark, sf_dir):
    label = F.concat(labels.layout_label(F.col("format")), F.lit("_"), F.col("buff_size").cast("string"))
    means = (
        d.measurements(spark, sf_dir)
        .withColumn("format_buff", label)
        .groupBy("compression", "format_buff")
        .agg(F.avg("datasize").alias("size"))
    )
    return means.select(
        "compression",
        "format_buff",
        F.round(rates.megabytes(F.col("size")), 9).alias("megabytes"),
        F.round(rates.gibibytes(F.col("size")), 9).alias("gibibytes"),
    )


@query("agg17_distinct_values", WITH + "SELECT DISTINCT server_comp_par FROM measurements")
def distinct_values(spark, sf_dir):
    return summarize.distinct_values(d.measurements(spark, sf_dir), "server_comp_par")


NAMED_CONFIGS = {
    "cc": {"client_decomp_par": 2, "server_comp_par": 2, "server_read_partitions": 1},
    "cf": {"client_decomp_par": 4, "server_comp_par": 4, "server_read_partitions": 1},
    "ff": {"client_write_par": 8, "client_decomp_par": 1, "server_read_partitions": 1},
}


@query(
    "agg18_named_configs",
    WITH + 'SELECT "table", '
    + ", ".join(
        "avg(time) FILTER (" + " AND ".join(f"{k} = {v}" for k, v in c.items()) + f") AS {n}"
        for n, c in NAMED_CONFIGS.items()
    )
    + " FROM measurements GROUP BY 1",
)
def named_configs(spark, sf_dir):
    return summarize.config_comparison(d.measurements(spark, sf_dir), "table", "time", NAMED_CONFIGS)


@query(
    "agg19_non_null_counts",
    WITH + "SELECT count(CASE WHEN run > 2 THEN time END) AS time, count(CASE WHEN run > 4 THEN datasize END) AS datasize, "
    "count(host) AS host FROM measurements",
)
def non_null_counts(spark, sf_dir):
    df = d.measurements(spark, sf_dir).select(
        F.when(F.col("run") > 2, F.col("time")).alias("time"),
        F.when(F.col("run") > 4, F.col("datasize")).alias("datasize"),
        "host",
    )
    return summarize.non_null_counts(df, df.columns)


@query(
    "agg20_codec_by_network",
    WITH + "SELECT compression, "
    + ", ".join(f"coalesce(avg(time) FILTER (network = {n}), 0) AS net_{n}" for n in (0, 125, 500, 1000))
    + " FROM measurements GROUP BY 1",
)
def codec_by_network(spark, sf_dir):
    networks = (0, 125, 500, 1000)
    return summarize.pivot_table(
        d.measurements(spark, sf_dir), "compression", "network", "time", networks, names={n: f"net_{n}" for n in networks}
    )


@query(
    "agg20_pool_by_block",
    WITH + "SELECT bufpool_size, "
    + ", ".join(f"coalesce(avg(time) FILTER (buff_size = {b}), 0) AS block_{b}" for b in (64, 256, 1024, 2048))
    + " FROM measurements GROUP BY 1",
)
def pool_by_block(spark, sf_dir):
    sizes = (64, 256, 1024, 2048)
    return summarize.pivot_table(
        d.measurements(spark, sf_dir), "bufpool_size", "buff_size", "time", sizes, names={b: f"block_{b}" for b in sizes}
    )


# --- order and best rows ----------------------------------------------------------------------


@query("srt1_first_rows", WITH + f"SELECT date, run, time FROM measurements ORDER BY {ALL_SQL} LIMIT 20000")
def first_rows(spark, sf_dir):
    df = d.measurements(spark, sf_dir)
    return ranking.first_rows(df, 20000, list(d.MEASUREMENTS)).select("date", "run", "time")


@query(
    "srt2_largest",
    WITH + f"SELECT date, run, host, time FROM measurements ORDER BY time DESC, date, run, host LIMIT 10",
)
def largest(spark, sf_dir):
    df = d.measurements(spark, sf_dir).select("date", "run", "host", "time")
    return ranking.largest(df, 10, "time", ["date", "run", "host"])


ENV_SQL = "concat('C', client_cpu, ' S', server_cpu, ' N', network)"


def _with_environment(spark, sf_dir):
    label = labels.environment_label(F.col("client_cpu"), F.col("server_cpu"), F.col("network"))
    return d.measurements(spark, sf_dir).withColumn("environment", label)


_BEST_SQL = (
    f", e AS (SELECT {ENV_SQL} AS environment, * FROM measurements), best AS (SELECT * FROM e QUALIFY row_number() OVER "
    f"(PARTITION BY environment ORDER BY time, date, run, host, {ALL_SQL}) = 1)"
)
_BEST_ORDER = ["time", "date", "run", "host", *d.MEASUREMENTS]


@query(
    "srt3_best_per_environment",
    WITH + _BEST_SQL + " SELECT environment, time, date, compression, buff_size, client_decomp_par FROM best",
)
def best_per_environment(spark, sf_dir):
    best = ranking.best_per_group(_with_environment(spark, sf_dir), ["environment"], _BEST_ORDER)
    return best.select("environment", "time", "date", "compression", "buff_size", "client_decomp_par")


@query(
    "srt4_all_minima",
    WITH + "SELECT date, run, bufpool_size, buff_size, time FROM measurements WHERE time = (SELECT min(time) FROM measurements)",
)
def all_minima(spark, sf_dir):
    return ranking.all_minima(d.measurements(spark, sf_dir), "time").select(
        "date", "run", "bufpool_size", "buff_size", "time"
    )


@query(
    "srt6_best_codec",
    WITH + ", t AS (SELECT \"table\", compression, max(floor(datasize / 1e8)) AS throughput FROM measurements GROUP BY 1, 2) "
    "SELECT \"table\", compression, throughput FROM t QUALIFY row_number() OVER (PARTITION BY \"table\" ORDER BY "
    "throughput DESC, list_position(['nocomp', 'zstd', 'lz4', 'lzo', 'snappy'], compression)) = 1",
)
def best_codec(spark, sf_dir):
    per_codec = (
        d.measurements(spark, sf_dir)
        .groupBy("table", "compression")
        .agg(F.max(F.floor(F.col("datasize") / 1e8)).cast("double").alias("throughput"))
    )
    return ranking.best_codec(per_codec, ["table"], "compression", "throughput", CODECS)


@query(
    "srt8_custom_order",
    WITH + f"SELECT DISTINCT {LABELS_SQL} AS \"table\", CAST(list_position(['lineitem', 'acs', 'iot', 'icu'], {LABELS_SQL}) "
    "- 1 AS BIGINT) AS table_rank, compression, compression <> 'nocomp' AS compressed, network, "
    "CASE WHEN network = 0 THEN 'local' ELSE CAST(network AS VARCHAR) END AS network_label FROM measurements",
)
def custom_order(spark, sf_dir):
    short = labels.relabel(F.col("table"), TABLE_LABELS)
    df = d.measurements(spark, sf_dir).select(short.alias("table"), "compression", "network").distinct()
    ranked = df.select(
        "table",
        labels.category_rank(F.col("table"), TABLE_ORDER).alias("table_rank"),
        "compression",
        (F.col("compression") != "nocomp").alias("compressed"),
        "network",
        labels.network_label(F.col("network")).alias("network_label"),
    )
    return ranked.orderBy(
        "table_rank",
        *labels.first_then_sorted(F.col("compression"), "nocomp"),
        *labels.unlimited_last(F.col("network")),
    )


_OPTIMIZERS = ("expert_iot_analysis", "heuristic", "expert_copy", "other", "bf", "expert_icu_analysis", "expert_pg", "expert_backup", "expert_etl")
_OPTIMIZER_SQL = d.pick("o_custkey % 9", *_OPTIMIZERS)
_LABEL_SQL = "CASE optimizer " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OPTIMIZER_LABELS.items()) + " ELSE optimizer END"


@query(
    "srt8_optimizer_order",
    f"WITH r AS (SELECT {_OPTIMIZER_SQL} AS optimizer, o_totalprice AS price FROM orders), l AS (SELECT {_LABEL_SQL} AS optimizer, "
    f"price FROM r) SELECT optimizer, CAST(nullif(list_position([{', '.join(repr(x) for x in OPTIMIZER_ORDER)}], optimizer), 0) - 1 "
    "AS BIGINT) AS place, count(*) AS runs, min(price) AS lowest FROM l GROUP BY 1",
)
def optimizer_order(spark, sf_dir):
    """Runs per optimizer in report order; an optimizer outside it has no place and comes last."""
    runs = d.table(spark, sf_dir, "orders").select(F.expr(_OPTIMIZER_SQL).alias("optimizer"), F.col("o_totalprice").alias("price"))
    label = labels.relabel(F.col("optimizer"), OPTIMIZER_LABELS)
    found = runs.groupBy(label.alias("optimizer")).agg(F.count("*").alias("runs"), F.min("price").alias("lowest"))
    placed = found.withColumn("place", labels.category_rank(F.col("optimizer"), OPTIMIZER_ORDER))
    return placed.orderBy(F.col("place").asc_nulls_last(), "optimizer")


@query(
    "srt9_descending_curve",
    WITH + "SELECT row_number() OVER (ORDER BY time DESC) - 1 AS idx, time FROM measurements WHERE time > 0",
)
def descending_curve(spark, sf_dir):
    return ordering.descending_curve(d.measurements(spark, sf_dir).select("time"), "time")


@query("srt10_multi_key_sort", WITH + "SELECT bufpool_size, buff_size, compression, format, time FROM measurements")
def multi_key_sort(spark, sf_dir):
    df = d.measurements(spark, sf_dir).select("bufpool_size", "buff_size", "compression", "format", "time")
    return df.orderBy("bufpool_size", "buff_size", "compression", "format", "time")


# --- duplicates and sets ----------------------------------------------------------------------


@query(
    "set3_first_per_configuration",
    WITH + f"SELECT {ALL_SQL} FROM measurements WHERE time > 3 QUALIFY row_number() OVER (PARTITION BY {CONFIG_SQL} "
    f"ORDER BY {REST_SQL}) = 1",
)
def first_per_configuration(spark, sf_dir):
    df = d.measurements(spark, sf_dir).filter(F.col("time") > 3)
    return dedup.first_per_key(df, CONFIG_COLUMNS, REST)


@query(
    "set4_duplicate_members",
    WITH + f"SELECT {ALL_SQL} FROM measurements WHERE time > 3 QUALIFY count(*) OVER (PARTITION BY {CONFIG_SQL}) > 1",
)
def duplicate_members(spark, sf_dir):
    df = d.measurements(spark, sf_dir).filter(F.col("time") > 3)
    return dedup.duplicate_members(df, CONFIG_COLUMNS)


_SUBSET = ("system", "table", "compression", *PARAMS)
_SUBSET_SQL = ", ".join(f'"{c}"' for c in _SUBSET)
_SUBSET_REST = [c for c in d.MEASUREMENTS if c not in _SUBSET]


@query(
    "set5_first_per_subset",
    WITH + f"SELECT {ALL_SQL} FROM measurements QUALIFY row_number() OVER (PARTITION BY {_SUBSET_SQL} ORDER BY "
    + ", ".join(f'"{c}"' for c in _SUBSET_REST) + ") = 1",
)
def first_per_subset(spark, sf_dir):
    return dedup.first_per_key(d.measurements(spark, sf_dir), _SUBSET, _SUBSET_REST)


# Wanted configurations: one per part number pattern, times layouts and networks (250 never ran).
_WANTED = {
    c: d.MEASUREMENTS[c].replace("l_partkey", "p_partkey")
    for c in ("system", "table", "compression", "bufpool_size", "buff_size")
}
_WANTED_SQL = (
    "base AS (SELECT DISTINCT "
    + ", ".join(f'{v.replace(" div ", " // ")} AS "{c}"' for c, v in _WANTED.items())
    + " FROM part), wanted AS (SELECT base.*, f.format, n.network FROM base, (VALUES (1), (2)) f(format), "
    "(VALUES (0), (125), (250)) n(network))"
)
_SHARED_SQL = ", ".join(f'"{c}"' for c in [*_WANTED, "format", "network"])


def _wanted(spark, sf_dir):
    base = d.table(spark, sf_dir, "part").select(*[F.expr(v).alias(c) for c, v in _WANTED.items()]).distinct()
    grid = slices.with_grid(base, {"format": [1, 2], "network": [0, 125, 250]})
    return grid.withColumn("format", F.col("format").cast("bigint"))


@query(
    "set1_missing_configurations",
    WITH + f", {_WANTED_SQL} SELECT {_SHARED_SQL} FROM wanted EXCEPT SELECT {_SHARED_SQL} FROM measurements",
)
def missing_configurations(spark, sf_dir):
    return dedup.missing_configs(_wanted(spark, sf_dir), d.measurements(spark, sf_dir), MEASURED_COLUMNS)


@query(
    "set7_progress_counts",
    WITH + f", {_WANTED_SQL}, done AS (SELECT DISTINCT {_SHARED_SQL} FROM measurements) "
    "SELECT (SELECT count(*) FROM wanted) AS generated, (SELECT count(*) FROM done) AS recorded, (SELECT count(*) FROM "
    f"(SELECT {_SHARED_SQL} FROM wanted EXCEPT SELECT {_SHARED_SQL} FROM done)) AS remaining",
)
def progress_counts(spark, sf_dir):
    return dedup.progress_counts(_wanted(spark, sf_dir), d.measurements(spark, sf_dir), MEASURED_COLUMNS)


@query(
    "set6_merged_records",
    "SELECT s_suppkey, e.env, coalesce(v.cpu, e.cpu, CAST(s_suppkey % 16 AS INTEGER)) AS client_cpu, "
    "coalesce(e.net, CAST(s_suppkey % 1000 AS INTEGER)) AS network, v.par AS comp_par FROM supplier, "
    "(VALUES ('weak', 2, NULL), ('local', NULL, 0)) e(env, cpu, net), (VALUES (1, NULL), (4, 8)) v(par, cpu)",
)
def merged_records(spark, sf_dir):
    """Base record of each supplier, overlaid with an environment and then with a variation."""
    base = d.table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        (F.col("s_suppkey") % 16).cast("int").alias("cpu"),
        (F.col("s_suppkey") % 1000).cast("int").alias("net"),
    )
    null = F.lit(None).cast("int")

    def env(name, cpu, net):
        return F.struct(F.lit(name).alias("env"), cpu.alias("cpu"), net.alias("net"))

    environments = F.array(env("weak", F.lit(2), null), env("local", null, F.lit(0)))
    varied = F.array(
        F.struct(F.lit(1).alias("par"), null.alias("cpu")), F.struct(F.lit(4).alias("par"), F.lit(8).alias("cpu"))
    )
    layered = slices.with_grid(base, {"e": environments, "v": varied})
    return layered.select(
        "s_suppkey",
        "e.env",
        slices.merged_record(F.col("cpu"), F.col("e.cpu"), F.col("v.cpu")).alias("client_cpu"),
        slices.merged_record(F.col("net"), F.col("e.net")).alias("network"),
        F.col("v.par").alias("comp_par"),
    )


# --- slices -----------------------------------------------------------------------------------

DEFAULTS = {p: 1 for p in PARAMS}
_SLICES_SQL = " UNION ALL ".join(
    f"SELECT date, run, time, '{p}' AS param, CAST({p} AS DOUBLE) AS level FROM measurements WHERE "
    + " AND ".join(f"{o} = 1" for o in PARAMS if o != p)
    for p in PARAMS
)


@query("fn2_one_at_a_time", WITH + _SLICES_SQL)
def one_at_a_time(spark, sf_dir):
    return slices.one_at_a_time(d.measurements(spark, sf_dir), DEFAULTS).select("date", "run", "time", "param", "level")


@query(
    "fn3_scale_one",
    "SELECT s_suppkey, p.scaled, v.scale, "
    + ", ".join(f"CASE WHEN p.scaled = '{p}' THEN v.scale ELSE 1 + s_suppkey % {m} END AS {p}"
                for p, m in (("read_par", 2), ("deser_par", 3), ("ser_par", 4)))
    + " FROM supplier, (VALUES ('read_par'), ('deser_par'), ('ser_par')) p(scaled), (VALUES (1), (2), (4), (8), (16)) v(scale)",
)
def scale_one(spark, sf_dir):
    base = d.table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        *[(1 + F.col("s_suppkey") % m).alias(p) for p, m in (("read_par", 2), ("deser_par", 3), ("ser_par", 4))],
    )
    return slices.scale_one(base, ["read_par", "deser_par", "ser_par"], [1, 2, 4, 8, 16]).select(
        "s_suppkey", "scaled", "scale", "read_par", "deser_par", "ser_par"
    )


_AROUND = ("client_decomp_par", "buff_size", "network_parallelism")
_AROUND_SQL = " UNION ALL ".join(
    f"SELECT e.date, e.run, e.environment, e.time, '{p}' AS param, CAST(e.{p} AS DOUBLE) AS level FROM e JOIN best b "
    "USING (environment) WHERE " + " AND ".join(f"e.{o} = b.{o}" for o in _AROUND if o != p)
    for p in _AROUND
)


@query("fn4_slices_around_best", WITH + _BEST_SQL + " " + _AROUND_SQL)
def slices_around_best(spark, sf_dir):
    around = slices.slices_around_best(_with_environment(spark, sf_dir), "environment", _AROUND, _BEST_ORDER)
    return around.select("date", "run", "environment", "time", "param", "level")


@query("fn5_relabel", WITH + f'SELECT date, run, {LABELS_SQL} AS "table" FROM measurements')
def relabelled(spark, sf_dir):
    return d.measurements(spark, sf_dir).select(
        "date", "run", labels.relabel(F.col("table"), TABLE_LABELS).alias("table")
    )


@query(
    "fn6_name_parts",
    "SELECT o_orderkey, string_split(o_orderpriority, '-')[-1] AS last_part, contains(o_orderpriority, 'URG') AS urgent, "
    "replace(o_orderpriority, 'NOT ', '') AS short FROM orders",
)
def name_parts(spark, sf_dir):
    value = F.col("o_orderpriority")
    return d.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        labels.last_part(value).alias("last_part"),
        value.contains("URG").alias("urgent"),
        F.replace(value, F.lit("NOT "), F.lit("")).alias("short"),
    )


@query(
    "fn7_labels",
    WITH + f"SELECT date, run, {ENV_SQL} AS environment, CASE format WHEN 1 THEN 'row' ELSE 'col' END || '_' || buff_size "
    "AS format_buff, compression || CASE format WHEN 1 THEN '(row)' ELSE '(col)' END AS codec_layout FROM measurements",
)
def report_labels(spark, sf_dir):
    df = _with_environment(spark, sf_dir)
    return df.select(
        "date",
        "run",
        "environment",
        F.concat(labels.layout_label(F.col("format")), F.lit("_"), F.col("buff_size").cast("string")).alias("format_buff"),
        labels.codec_layout_label(F.col("compression"), F.col("format")).alias("codec_layout"),
    )


@query(
    "fn8_parse_environment",
    WITH + "SELECT date, run, server_cpu, client_cpu, network, network_latency, network_loss FROM measurements",
)
def parse_environment(spark, sf_dir):
    names = ("server_cpu", "client_cpu", "network", "network_latency", "network_loss")
    keyed = d.measurements(spark, sf_dir).select(
        "date", "run", F.concat_ws("-", *[F.col(n).cast("string") for n in names]).alias("key")
    )
    return keyed.select("date", "run", *labels.parse_environment(F.col("key")).values())


@query(
    "fn16_recode_and_reindex",
    WITH + _BEST_SQL + ", wanted AS (SELECT unnest(['C2 S16 N0', 'C16 S16 N1000', 'C99 S1 N1']) AS environment) "
    "SELECT w.environment, CAST(CASE b.buff_size WHEN 256 THEN -1 WHEN 2048 THEN 1 ELSE b.buff_size END AS DOUBLE) "
    "AS buff_size FROM wanted w LEFT JOIN best b USING (environment)",
)
def recode_and_reindex(spark, sf_dir):
    best = ranking.best_per_group(_with_environment(spark, sf_dir), ["environment"], _BEST_ORDER)
    recoded = best.select(
        "environment", labels.relabel(F.col("buff_size"), {256: -1, 2048: 1}).cast("double").alias("buff_size")
    )
    wanted = spark.createDataFrame([("C2 S16 N0",), ("C16 S16 N1000",), ("C99 S1 N1",)], "environment string")
    return recoded.join(wanted, "environment", "right").select("environment", "buff_size")
