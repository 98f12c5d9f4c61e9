"""Best rows, n-th stages and orders. Best-of-group is an aggregate, never a window over the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rows(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows of an explicit order, in that order: a top-k per task and a merge.

    The ``n`` rows meet in one task. To cut off a share of a large table, filter the positions that
    ``ordering.with_position`` gives.
    """
    return df.orderBy(*order).limit(n)


def largest(df: DataFrame, n: int, value: str, tie_break: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(value).desc_nulls_last(), *tie_break).limit(n)


def best_per_group(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The row with the smallest ``by`` values per group (put a tie-break last)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*by)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def all_minima(df: DataFrame, value: str) -> DataFrame:
    """Every row that equals the overall minimum."""
    lowest = df.agg(F.min(value)).scalar()
    return df.filter(F.col(value) == lowest)


def nth_slowest(rates: Sequence[str], n: int) -> Column:
    """``(stage, rate)`` of the n-th slowest (0-based) non-zero stage; ties in the given order; else null."""
    stages = F.array(*[F.struct(F.col(c).alias("rate"), F.lit(i).alias("ord"), F.lit(c).alias("stage"))
                       for i, c in enumerate(rates)])
    ordered = F.array_sort(F.filter(stages, lambda s: s["rate"] != 0))
    return F.get(ordered, F.lit(n))


def best_codec(df: DataFrame, keys: Sequence[str], codec: str, throughput: str, order: Sequence[str]) -> DataFrame:
    """Codec with the highest throughput per key; the earlier one in ``order`` wins a tie."""
    from ..functions.labels import category_rank

    rank = F.struct(-F.col(throughput), category_rank(F.col(codec), order))
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(codec, throughput), rank).alias("_best")
    ).select(*keys, f"_best.{codec}", f"_best.{throughput}")


def latest_record(lines: DataFrame, column: str = "value", fields: int = 22) -> DataFrame:
    """Fields of the log line with the highest transfer id; a wrong field count fails the job."""
    # Only the id is cut out of every line; the newest line alone is split.
    transfer_id = F.substring_index(F.trim(column), ",", 1).try_cast("bigint")
    newest = lines.agg(
        F.max_by(F.trim(column), F.when(transfer_id.isNotNull(), F.struct(transfer_id, F.col(column)))).alias("_line")
    )
    parts = F.split("_line", ",")
    message = F.concat(F.lit(f"expected {fields} values, found "), F.size(parts).cast("string"))
    checked = F.when(F.size(parts) == fields, parts).otherwise(F.raise_error(message))
    found = newest.filter(F.col("_line").isNotNull()).select(checked.alias("fields"))
    return found.select(F.get("fields", F.lit(0)).cast("bigint").alias("transfer_id"), "fields")
