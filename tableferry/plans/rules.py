"""Bounds, estimated throughput and layout rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CEILINGS, STAGES, STORAGE_MODE, UNLIMITED_NETWORK, WORKERS_PER_CPU
from ..functions.rates import effective_rate, slowest_rate


def ceilings(spark) -> DataFrame:
    """Storage ceilings per target, source and mode: a fixed table of a few rows."""
    return spark.createDataFrame(
        [(t, s, m, float(r), float(w)) for t, s, m, r, w in CEILINGS],
        "target_system string, source_system string, mode int, read_ceiling double, write_ceiling double",
    )


def with_ceilings(df: DataFrame, mode: int = STORAGE_MODE, strict: bool = False) -> DataFrame:
    """Add the storage ceilings of a mode (of the row's own, if ``df`` has a column ``mode``).

    A combination without ceilings gets nulls, or fails the job if ``strict``.
    """
    known = ceilings(df.sparkSession)
    keys = ["target_system", "source_system"]
    if "mode" in df.columns:
        keys.append("mode")
    else:
        known = known.filter(F.col("mode") == mode).drop("mode")
    found = df.join(F.broadcast(known), keys, "left")
    if not strict:
        return found
    pair = F.concat_ws("_", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    unknown = F.raise_error(F.concat(F.lit("no ceilings for "), pair)).cast("double")
    return found.withColumns({c: F.coalesce(c, unknown) for c in ("read_ceiling", "write_ceiling")})


def network_ceiling(network: Column) -> Column:
    return F.when(network == 0, F.lit(float(UNLIMITED_NETWORK))).otherwise(network.cast("double"))


def throughput_bound(read: Column, write: Column, network: Column, codec: Column, ratio: Column) -> Column:
    """Lowest ceiling; if that is the network, compressed data may go faster by the codec's ratio.

    On equal ceilings storage counts as the lowest, because it comes first. An unknown storage
    ceiling leaves the bound unknown.
    """
    storage = F.when(read.isNotNull() & write.isNotNull(), F.least(read, write))
    net = network_ceiling(network)
    widened = F.when(codec == "nocomp", net).otherwise(F.try_divide(net, ratio))
    return F.when(net < storage, widened).otherwise(storage)


def worker_cap(cpus: Column) -> Column:
    return F.floor(cpus * F.lit(WORKERS_PER_CPU)).cast("int")


def stage_rates(stages: Sequence[str] = STAGES, workers: str = "{}_par") -> dict[str, Column]:
    """Effective rate of every stage with the configured workers."""
    return {s: effective_rate(F.col(s), F.col(workers.format(s))) for s in stages}


def config_throughput(df: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Estimated throughput of each configuration, and the effective rate of every stage."""
    rates = stage_rates(stages)
    detailed = df.withColumns({f"{s}_rate": r for s, r in rates.items()})
    return detailed.withColumn("throughput", slowest_rate(*[F.col(f"{s}_rate") for s in stages]))


def layout_rules(df: DataFrame, consider_skip: bool = True) -> DataFrame:
    """Layout, skip flags and target overrides, in the order in which they replace each other.

    Needs source/target systems and formats, the codec and the ``*_par`` columns.
    """
    source, target = F.col("source_system"), F.col("target_system")
    columnar = (F.col("source_format") == 2) | (F.col("target_format") == 2) | (F.col("compression") != "nocomp")
    same = (source == target) & target.isin("csv", "parquet")
    skip = same if consider_skip else F.lit(False)
    to_pandas, to_spark, to_db = target == "pandas", target == "spark", target == "postgres"
    one = F.lit(1)
    write_par = F.when(to_spark | to_db, one).otherwise(F.col("write_par"))
    ser_par = F.when(to_pandas, F.col("write_par")).when(skip, F.col("decomp_par")).otherwise(F.col("ser_par"))
    rules: Mapping[str, Column] = {
        "format": F.when(to_db, one).when(columnar, F.lit(2)).otherwise(one),
        "skip_ser": F.when(skip, one).otherwise(F.lit(0)),
        "skip_deser": F.when(skip, one).otherwise(F.lit(0)),
        "deser_par": F.when(skip, F.col("read_par")).otherwise(F.col("deser_par")),
        "ser_par": ser_par,
        "send_par": F.when(to_pandas, one).otherwise(F.col("send_par")),
        "rcv_par": F.when(to_pandas, one).otherwise(F.col("rcv_par")),
        "write_par": write_par,
    }
    return df.withColumns(dict(rules))
