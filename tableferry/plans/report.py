"""Predicted against measured throughput."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import lookup
from ..functions.rates import percent_error, real_throughput
from ..operators.summarize import estimation_error


def predicted_vs_actual(runs: DataFrame, sizes: Mapping[str, float], environment: str = "env_name") -> DataFrame:
    """Real throughput (size of the environment over runtime), difference and percent error per run."""
    sized = runs.withColumn("size", lookup(F.col(environment), sizes).cast("double"))
    real = sized.withColumn("real", real_throughput(F.col("size"), F.col("runtime")))
    return real.withColumns(
        {
            "difference": F.abs(F.col("estimated") - F.col("real")),
            "percentage_error": percent_error(F.col("estimated"), F.col("real")),
        }
    )


def optimizer_report(runs: DataFrame, sizes: Mapping[str, float], keys: Sequence[str]) -> DataFrame:
    """MAPE and RMSE of the estimates per key."""
    return estimation_error(predicted_vs_actual(runs, sizes), keys)
