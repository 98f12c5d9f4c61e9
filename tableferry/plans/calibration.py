"""Which runs to make: calibration plans and sensitivity grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CLIENT_STAGES, CODECS, SERVER_STAGES
from ..operators.slices import with_grid


def calibration_plan(environments: DataFrame, codecs: Sequence[str] = CODECS, parquet_block: int = 65536) -> DataFrame:
    """Single-worker runs to make for every active environment, table and codec.

    ``environments`` has name, active, source_system, target_system, source_format, target_format
    and an array ``tables``. Layout is 2 for compressed data, a pandas target or a columnar end;
    equal CSV or Parquet ends get a second run that skips the serializer.
    """
    source, target = F.col("source_system"), F.col("target_system")
    runs = with_grid(
        environments.filter(F.col("active") == 1), {"table": F.col("tables"), "compression": list(codecs)}
    )
    columnar = (
        (F.col("compression") != "nocomp")
        | (target == "pandas")
        | (F.col("source_format") == 2)
        | (F.col("target_format") == 2)
    )
    block = F.when(source == "parquet", F.lit(parquet_block)).otherwise(F.lit(1024))
    same = (source == target) & target.isin("csv", "parquet")
    return runs.select(
        "name",
        "source_system",
        "target_system",
        "table",
        "compression",
        F.when(columnar, 2).otherwise(1).alias("format"),
        block.alias("buffer_size"),
        (block * 4 * 3).alias("bufferpool_size"),
        F.explode(F.when(same, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("skip_ser"),
    )


def sweep_grid(bases: DataFrame, workers: Sequence[int], codecs: Sequence[str] = CODECS) -> DataFrame:
    """Full sweep for each base row: read, deser, comp, decomp, ser and write workers x codecs.

    Pool sizes hold (all workers of the side + 4) blocks of 1024 KiB three times. A base row of some bytes becomes tens of
    thousands of rows, so base rows are dealt to as many tasks as a shuffle has, however few files hold them.
    """
    swept = ("read_par", "deser_par", "comp_par", "decomp_par", "ser_par", "write_par")
    dealt = bases.repartition(int(bases.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grid = with_grid(dealt, {"compression": list(codecs), **{p: list(workers) for p in swept}})
    grid = grid.withColumns({"send_par": F.lit(1), "rcv_par": F.lit(1)})

    def pool(stages: Sequence[str]) -> Column:
        total = F.lit(4)
        for s in stages:
            total = total + F.col(f"{s}_par")
        return total * 1024 * 3

    return grid.withColumns(
        {"server_buffpool_size": pool(SERVER_STAGES), "client_buffpool_size": pool(CLIENT_STAGES)}
    )


def sensitivity_grid(
    bases: DataFrame,
    client_cpus: Sequence[int],
    networks: Sequence[int],
    cpu_configs: Mapping[str, Mapping[str, object]],
    network_configs: Mapping[str, Mapping[str, object]],
    fixed_client_cpu: int = 8,
) -> DataFrame:
    """Runs over the client's CPUs at the row's network, and over networks at a fixed CPU count.

    Each series runs its own named configurations.
    """

    def series(axis: str, cpu: Column, net: Column, configs: Mapping[str, Mapping[str, object]]) -> DataFrame:
        chosen = F.array(
            *[
                F.struct(F.lit(name).alias("config"), *[F.lit(v).alias(k) for k, v in settings.items()])
                for name, settings in configs.items()
            ]
        )
        return (
            bases.withColumn("axis", F.lit(axis))
            .withColumn("client_cpu", F.explode(cpu) if axis == "client_cpu" else cpu)
            .withColumn("network", F.explode(net) if axis == "network" else net)
            .select("*", F.inline(chosen))
        )

    def listed(values: Sequence[int]) -> Column:
        return F.array(*[F.lit(v).cast("int") for v in values])

    by_cpu = series("client_cpu", listed(client_cpus), F.col("network").cast("int"), cpu_configs)
    by_network = series("network", F.lit(fixed_client_cpu).cast("int"), listed(networks), network_configs)
    return by_cpu.unionByName(by_network)
