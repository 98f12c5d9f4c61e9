"""Single-worker stage rates per environment, codec and skip flag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CLIENT_STAGES, SERVER_STAGES, STAGES
from ..operators.select import all_equal, columns_like, matches

ENVIRONMENT = ("server_cpu", "client_cpu", "network", "source_system", "target_system", "table")
SETTING = ("compression", "skip_ser")


def single_worker_runs(stats: DataFrame, where: Mapping[str, object] | None = None) -> DataFrame:
    """Runs of one environment (or of all) in which every parallelism column is 1."""
    runs = stats.filter(matches(where)) if where else stats
    return runs.filter(all_equal(columns_like(stats, "_par"), 1))


def base_rates(
    stats: DataFrame,
    server_timings: DataFrame,
    client_timings: DataFrame,
    where: Mapping[str, object] | None = None,
    keys: Sequence[str] = ENVIRONMENT + SETTING,
) -> DataFrame:
    """Mean per-block rate of each stage over the single-worker runs; no runs give no row.

    Both timing logs are stacked, so the runs are joined once and each side's mean skips the other
    side's rows. The network rate is the better of sending and receiving, used for both.
    """
    runs = single_worker_runs(stats, where).select(F.col("date").alias("transfer_id"), *keys).distinct()
    server = server_timings.select("transfer_id", *[f"{s}_throughput_pb" for s in SERVER_STAGES])
    client = client_timings.select("transfer_id", *[f"{s}_throughput_pb" for s in CLIENT_STAGES])
    timings = server.unionByName(client, allowMissingColumns=True)
    means = (
        timings.join(runs, "transfer_id")
        .groupBy(*keys)
        .agg(*[F.avg(f"{s}_throughput_pb").alias(s) for s in STAGES])
    )
    network = F.greatest("send", "rcv")
    return means.withColumns({"send": network, "rcv": network})
