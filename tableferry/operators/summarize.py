"""Aggregates over transferred tables and measurement logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import percent_error


def first_attribute_stats(df: DataFrame, column: str) -> DataFrame:
    """Fold of one integer attribute: total rows, counted rows, min, max, sum and average.

    The sum is kept wide, so it cannot overflow at any table size. No rows give nulls.
    """
    value = F.col(column)
    total = F.sum(value.cast("decimal(20,0)"))
    return df.agg(
        F.count("*").alias("totalcnt"),
        F.count(value).alias("cnt"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        total.alias("sum"),
        F.try_divide(total.cast("double"), F.count(value)).alias("avg"),
    )


def mean_by(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    how: str = "avg",
    drop_null_keys: bool = True,
) -> DataFrame:
    """Mean (or min, max, sum, ...) of the values per key; by default a null key forms no group."""
    if drop_null_keys:
        df = df.dropna(subset=list(keys))
    return df.groupBy(*keys).agg(*[getattr(F, how)(v).alias(v) for v in values])


def pivot_table(
    df: DataFrame,
    row: str,
    column: str,
    value: str,
    columns: Sequence,
    rows: Sequence | None = None,
    how: str = "avg",
    names: Mapping | None = None,
) -> DataFrame:
    """Row x column table of an aggregate with fixed columns (and rows); an absent cell is 0.

    Fixed column values save the pass that would discover them. Rows asked for but absent appear
    with zeros, rows not asked for are left out.
    """
    agg = getattr(F, how)(value)
    table = df.groupBy(row).pivot(column, list(columns)).agg(agg)
    if rows is not None:
        kind = df.schema[row].dataType
        wanted = df.sparkSession.createDataFrame([(r,) for r in rows], f"`{row}` {kind.simpleString()}")
        table = wanted.join(table, row, "left")
    shown = names or {}
    return table.select(
        row, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(str(shown.get(c, c))) for c in columns]
    )


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def side_by_side_means(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column means of two tables put next to each other, whatever their lengths.

    Rows are stacked with nulls for the other side's columns, which a mean leaves out.
    """
    return column_means(left.unionByName(right, allowMissingColumns=True), columns)


def compression_ratios(stats: DataFrame, keys: Sequence[str], codecs: Sequence[str]) -> DataFrame:
    """Mean moved size per codec over the uncompressed mean; ``nocomp`` is 1.

    No uncompressed run (or size 0) gives 0, a codec never run gives null.
    """
    sizes = {c: F.avg(F.when(F.col("compression") == c, F.col("datasize"))) for c in codecs}
    means = stats.groupBy(*keys).agg(*[m.alias(f"_{c}") for c, m in sizes.items()])
    base = F.col("_nocomp")
    out = []
    for c in codecs:
        ratio = F.lit(1.0) if c == "nocomp" else F.when(base > 0, F.col(f"_{c}") / base).otherwise(F.lit(0.0))
        out.append(ratio.alias(f"{c}_ratio"))
    return means.select(*keys, *out)


def parallel_throughput(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean throughput per component and parallelism, and ``parallelism * mean`` as the overall rate."""
    grouped = long.groupBy(*keys, "component", "parallelism").agg(F.avg("throughput").alias("throughput"))
    return grouped.withColumn("overall_throughput", F.col("parallelism") * F.col("throughput"))


def weighted_throughput(long: DataFrame, components: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Sum of throughput x parallelism over all rows (nulls included in the count), known components only."""
    return (
        long.filter(F.col("component").isin(*components))
        .groupBy(*keys, "component")
        .agg((F.sum(F.col("throughput") * F.col("parallelism")) / F.count("*")).alias("throughput"))
    )


def mean_and_spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_sd"), F.count(value).alias("n")
    )


def average_cpu(df: DataFrame, keys: Sequence[str], sample: str) -> DataFrame:
    """Sum of the numeric samples over all samples, unreadable ones included; no samples give 0."""
    number = F.col(sample).try_cast("double")
    readable = F.col(sample).rlike(r"^[0-9]+(\.[0-9]+)?$")
    total = F.coalesce(F.sum(F.when(readable, number)), F.lit(0.0))
    return df.groupBy(*keys).agg((total / F.count("*")).alias("average_cpu"), F.count("*").alias("samples"))


def estimation_error(df: DataFrame, keys: Sequence[str] = (), estimated: str = "estimated", real: str = "real") -> DataFrame:
    """Mean absolute percentage error and root mean squared error."""
    e, r = F.col(estimated), F.col(real)
    return df.groupBy(*keys).agg(
        F.avg(percent_error(e, r)).alias("mape"), F.sqrt(F.avg((r - e) * (r - e))).alias("rmse")
    )


def distinct_pairs(df: DataFrame, keys: Sequence[str], pair: Sequence[str]) -> DataFrame:
    """Per key the set of distinct pairs, as rows in order: a key may have any number of them."""
    return df.select(*keys, *pair).distinct().orderBy(*keys, *pair)


def pair_sets(df: DataFrame, keys: Sequence[str], pair: Sequence[str]) -> DataFrame:
    """The same with one row per key and its pairs as a sorted array; for pairs of few values, such as systems.

    Duplicates go before the shuffle, so a key costs its distinct pairs only.
    """
    pairs = F.sort_array(F.collect_list(F.struct(*pair))).alias("pairs")
    return df.select(*keys, *pair).distinct().groupBy(*keys).agg(pairs)


def non_null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count(c).alias(c) for c in columns])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).dropna().distinct().orderBy(column)


def config_comparison(
    df: DataFrame, row: str, value: str, configs: Mapping[str, Mapping[str, object]], how: str = "avg"
) -> DataFrame:
    """Named configurations side by side per dataset, matched by key and not by position."""
    from .select import matches

    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, settings in configs.items():
        label = label.when(matches(settings), F.lit(name))
    chosen = df.withColumn("_label", label).filter(F.col("_label").isNotNull())
    return chosen.groupBy(row).pivot("_label", list(configs)).agg(getattr(F, how)(value))


def average_load(samples: DataFrame, queues: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean length of each queue over the samples; no samples give zeros."""
    return samples.groupBy(*keys).agg(*[F.coalesce(F.avg(q), F.lit(0.0)).alias(q) for q in queues])


def counter_delta(df: DataFrame, keys: Sequence[str], counter: str) -> DataFrame:
    """Growth of a running counter per run: end reading minus start reading."""
    return df.groupBy(*keys).agg((F.max(counter) - F.min(counter)).alias("moved"))


def serial_fractions(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Serial fraction per component and parallelism against the same component's single-worker rate.

    Only the averaged rows are joined: one per component and parallelism.
    """
    from ..functions.rates import serial_fraction

    grouped = parallel_throughput(long, keys)
    base = grouped.filter(F.col("parallelism") == 1).select(
        *keys, "component", F.col("throughput").alias("base_throughput")
    )
    share = serial_fraction(F.col("base_throughput"), F.col("overall_throughput"), F.col("parallelism"))
    return grouped.join(base, [*keys, "component"], "left").withColumn("s", share)


def transfer_progress(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elapsed whole milliseconds and blocks written, summed over the writers."""
    pushes = F.count(F.when((F.col("component") == "write") & (F.col("event") == "push"), 1))
    elapsed = F.floor((F.max("ts_us") - F.min("ts_us")) / 1000).cast("bigint")
    return log.groupBy(*keys).agg(elapsed.alias("totalTime_ms"), pushes.alias("bufTransferred"))
