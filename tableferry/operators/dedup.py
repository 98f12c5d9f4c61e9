"""Duplicates and set differences of configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hash(keys: Sequence[str]) -> Column:
    """One number that stands before many keys: sorts and comparisons then rarely look at the keys themselves."""
    return F.xxhash64(*[F.col(k) for k in keys])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order`` and then by the other columns; null keys count as equal, like any other value.

    A min aggregate, not a numbered window: copies of a hot key shrink before the shuffle.
    """
    ordered = [c for c in order if c not in keys]
    rest = [*ordered, *[c for c in df.columns if c not in keys and c not in ordered]]
    best = F.min(F.struct(*rest)).alias("_first")
    return df.groupBy(_hash(keys).alias("_hash"), *keys).agg(best).select(*keys, "_first.*").select(*df.columns)


def _same_keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]


def duplicate_members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once.

    Keys are counted with map-side combining and meet the rows in one semi join: two scans. A hot
    key is one row on the right, so adaptive execution may split its rows on the left.
    """
    hashed = df.withColumn("_hash", _hash(keys))
    repeated = hashed.groupBy("_hash", *keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    same = [F.col("l._hash") == F.col("r._hash"), *_same_keys(keys)]
    return hashed.alias("l").join(repeated.alias("r"), same, "left_semi").drop("_hash")


def cleaning_counts(df: DataFrame, kept_predicate, keys: Sequence[str]) -> DataFrame:
    """Rows before cleaning, rejected by the predicate, duplicates removed and rows left: one row."""
    per_key = (
        df.withColumn("_kept", F.coalesce(kept_predicate, F.lit(False)))
        .groupBy("_kept", *keys)
        .agg(F.count("*").alias("_n"))
    )
    kept = F.when(F.col("_kept"), F.col("_n"))
    return per_key.agg(
        F.sum("_n").alias("original"),
        F.coalesce(F.sum(F.when(~F.col("_kept"), F.col("_n"))), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum(kept - 1), F.lit(0)).alias("duplicates_removed"),
        F.count(kept).alias("remaining"),
    )


def missing_configs(wanted: DataFrame, recorded: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Distinct wanted configurations not recorded yet, compared on all shared columns."""
    shared = [c for c in wanted.columns if c in recorded.columns and c not in ignore]
    done = recorded.select(*shared).distinct().alias("r")
    left = wanted.distinct().alias("l")
    same = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in shared]
    return left.join(done, same, "left_anti")


def progress_counts(wanted: DataFrame, recorded: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Generated, recorded (distinct) and remaining configurations in one row."""
    shared = [c for c in wanted.columns if c in recorded.columns and c not in ignore]
    tagged = (
        wanted.select(*shared, F.lit(1).alias("_w"), F.lit(0).alias("_r"))
        .unionByName(recorded.select(*shared, F.lit(0).alias("_w"), F.lit(1).alias("_r")))
        .groupBy(*shared)
        .agg(F.sum("_w").alias("w"), F.sum("_r").alias("r"))
    )
    return tagged.agg(
        F.sum("w").alias("generated"),
        F.count(F.when(F.col("r") > 0, 1)).alias("recorded"),
        F.count(F.when((F.col("w") > 0) & (F.col("r") == 0), 1)).alias("remaining"),
    )


def append_new(existing: DataFrame, batch: DataFrame, id_column: str, unique_in_batch: bool = False) -> DataFrame:
    """Rows of ``batch`` whose id is not stored yet.

    Repeats inside the batch stay, as in the append this models; ``unique_in_batch`` drops them.
    """
    fresh = batch.join(existing.select(id_column).distinct(), id_column, "left_anti")
    return fresh.dropDuplicates([id_column]) if unique_in_batch else fresh
