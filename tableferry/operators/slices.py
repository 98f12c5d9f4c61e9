"""Wide to long, parameter grids, and one-parameter-at-a-time slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import best_per_group


def stages_to_long(df: DataFrame, keys: Sequence[str], stages: Sequence[str]) -> DataFrame:
    """One row per stage with its parallelism and per-block throughput, in one pass over ``df``."""
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("component"),
                F.col(f"{s}_par").alias("parallelism"),
                F.col(f"{s}_throughput_pb").alias("throughput"),
            )
            for s in stages
        ]
    )
    return df.select(*keys, F.inline(rows))


def with_grid(df: DataFrame, params: Mapping[str, Sequence | Column]) -> DataFrame:
    """Every combination of the parameter lists for every row of ``df``.

    Lists are generated row by row, so no table is multiplied by another. A list may be an array
    column that depends on earlier parameters, which prunes while generating.
    """
    for name, values in params.items():
        choices = values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
        df = df.withColumn(name, F.explode(choices))
    return df


def merged_record(*layers: Column) -> Column:
    """Value of the last layer that has one (``{**first, **second, ...}`` for one key)."""
    return F.coalesce(*reversed(layers))


def one_at_a_time(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Rows for each parameter's curve: all other parameters at their default, this one free.

    One pass: a row off the default in one place belongs to that parameter's curve, a row on all
    defaults to every curve, any other row to none.
    """
    off = F.filter(
        F.array(*[F.when(~F.col(p).eqNullSafe(F.lit(v)), F.lit(p)) for p, v in defaults.items()]),
        lambda p: p.isNotNull(),
    )
    curves = F.when(F.size("_off") == 0, F.array(*[F.lit(p) for p in defaults])).otherwise(F.col("_off"))
    kept = df.withColumn("_off", off).filter(F.size("_off") <= 1)
    long = kept.withColumn("param", F.explode(curves)).drop("_off")
    return long.withColumn("level", _level(defaults))


def _level(params: Sequence[str] | Mapping) -> Column:
    level = F.when(F.lit(False), F.lit(None).cast("double"))
    for p in params:
        level = level.when(F.col("param") == p, F.col(p).try_cast("double"))
    return level


def scale_one(df: DataFrame, params: Sequence[str], values: Sequence[int]) -> DataFrame:
    """For each base row one configuration per parameter and value, only that parameter changed."""
    grid = with_grid(df, {"scaled": list(params), "scale": list(values)})
    changed = {p: F.when(F.col("scaled") == p, F.col("scale")).otherwise(F.col(p)) for p in params}
    return grid.withColumns(changed)


def slices_around_best(df: DataFrame, env: str, params: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per environment the rows that differ from its best row in at most the one free parameter.

    The best rows are one per environment; the join has no hint, so Spark compares its size with
    the broadcast limit and splits hot environments otherwise.
    """
    best = best_per_group(df, [env], by).select(env, *[F.col(p).alias(f"_best_{p}") for p in params])
    joined = df.join(best, env)
    off = F.filter(
        F.array(*[F.when(~F.col(p).eqNullSafe(F.col(f"_best_{p}")), F.lit(p)) for p in params]),
        lambda p: p.isNotNull(),
    )
    curves = F.when(F.size("_off") == 0, F.array(*[F.lit(p) for p in params])).otherwise(F.col("_off"))
    kept = joined.withColumn("_off", off).filter(F.size("_off") <= 1).withColumn("param", F.explode(curves))
    return kept.withColumn("level", _level(params)).select(*df.columns, "param", "level")
