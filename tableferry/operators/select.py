"""Column choices and predicates on measurement tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names)


def drop_columns(df: DataFrame, names: Sequence[str], strict: bool = False) -> DataFrame:
    """Without the named columns; ``strict`` refuses a name that is not there."""
    missing = [n for n in names if n not in df.columns]
    if strict and missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*names)


def columns_like(df: DataFrame, part: str) -> list[str]:
    """Names that contain ``part`` (``_par`` therefore also finds ``read_partitions``)."""
    return [c for c in df.columns if part in c]


def prefixed(df: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in names])


def matches(values: Mapping[str, object]) -> Column:
    """All of the columns equal their values."""
    return reduce(and_, [F.col(c) == F.lit(v) for c, v in values.items()], F.lit(True))


def all_equal(columns: Sequence[str], value: object) -> Column:
    return matches(dict.fromkeys(columns, value))


def split_by(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Kept and rejected rows. Every row is in exactly one of them: an unknown predicate rejects."""
    known = F.coalesce(predicate, F.lit(False))
    return df.filter(known), df.filter(~known)


def save_split(df: DataFrame, predicate: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """Saves kept and rejected rows below ``path`` in one pass over ``df``; returns them as they were saved."""
    known = F.coalesce(predicate, F.lit(False)).alias("_kept")
    df.select("*", known).write.partitionBy("_kept").parquet(path)
    saved = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_kept", T.BooleanType())])).parquet(path)
    return saved.filter("_kept").drop("_kept"), saved.filter("not _kept").drop("_kept")
