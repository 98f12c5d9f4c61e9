"""Flat table schemas: ordered attributes with a name, one of four types and a byte size."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed_values import TEXT_WIDTH, TYPE_BYTES
from .functions.fixed_text import cut_bytes


class Attribute(NamedTuple):
    name: str
    type: str
    size: int

    @property
    def bytes(self) -> int:
        return TYPE_BYTES.get(self.type, self.size)

    @property
    def text_width(self) -> int:
        return TEXT_WIDTH.get(self.type, self.size + 1)


_SPARK_TYPES = {"INT": T.IntegerType, "DOUBLE": T.DoubleType, "CHAR": T.StringType, "STRING": T.StringType}


def struct_of(attributes: Iterable[Attribute | tuple], wide_ints: bool = False) -> T.StructType:
    """Spark schema of the attributes; type and size travel in the field metadata.

    ``wide_ints`` reads INT as 64-bit, for keys that outgrow 32 bits.
    """
    fields = []
    for raw in attributes:
        a = Attribute(*raw)
        if a.type not in _SPARK_TYPES:
            raise ValueError(f"unsupported attribute type {a.type!r} for {a.name!r}")
        if a.size <= 0:
            raise ValueError(f"attribute {a.name!r} needs a positive size")
        spark_type = T.LongType() if wide_ints and a.type == "INT" else _SPARK_TYPES[a.type]()
        fields.append(T.StructField(a.name, spark_type, True, {"type": a.type, "size": a.size}))
    return T.StructType(fields)


def schema_from_json(path: str, spark: SparkSession | None = None, wide_ints: bool = False) -> T.StructType:
    """Schema from a JSON array of ``{name, type, size}``; a missing file is an error.

    With a session the file is read through Spark, so any file system it knows works.
    """
    if spark is None:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    else:
        text = spark.read.text(path, wholetext=True).first()[0]
    return struct_of([Attribute(a["name"], a["type"], a["size"]) for a in json.loads(text)], wide_ints)


def attributes_of(schema: T.StructType) -> list[Attribute]:
    return [Attribute(f.name, f.metadata["type"], f.metadata["size"]) for f in schema.fields]


def row_bytes(schema: T.StructType) -> int:
    return sum(a.bytes for a in attributes_of(schema))


def rows_per_block(schema: T.StructType, block_kib: int) -> int:
    return block_kib * 1024 // row_bytes(schema)


def max_text_row(schema: T.StructType) -> int:
    """Largest number of bytes one row can need as a text line (a DOUBLE's up to 21 digits)."""
    wide = sum(TEXT_WIDTH["LONG"] - TEXT_WIDTH["INT"] for f in schema.fields if isinstance(f.dataType, T.LongType))
    return wide + sum(a.text_width for a in attributes_of(schema))


def _required(value: Column, name: str, kind: T.DataType) -> Column:
    message = F.lit(f"column {name}: value is null or does not fit {kind.simpleString()}")
    return F.coalesce(value, F.raise_error(message).cast(kind))


def _typed(field: T.StructField) -> Column:
    """The column in the field's type: text cut to its size, null for a number that does not fit."""
    value = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return cut_bytes(value.cast("string"), Attribute(field.name, **field.metadata).bytes)
    return value.try_cast(field.dataType)


def enforce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns and types, in its order.

    A null or a number out of range fails the job instead of travelling on; text is cut to its size.
    """
    return df.select(
        *[_required(_typed(f), f.name, f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields]
    )


def nulls_allowed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The same, but for nulls, which stay; a number out of range still fails the job."""
    out = []
    for f in schema.fields:
        checked = F.when(F.col(f.name).isNotNull(), _required(_typed(f), f.name, f.dataType))
        out.append(checked.alias(f.name, metadata=f.metadata))
    return df.select(*out)


def narrow_numbers(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fails on a DOUBLE that prints wider than the width the format reckons with: sign, digits, two decimals, delimiter."""
    most = 10.0 ** (TEXT_WIDTH["DOUBLE"] - 5)
    out = []
    for f in schema.fields:
        value = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            message = F.lit(f"column {f.name}: value is too wide for files of bounded size")
            value = F.when(F.abs(value) >= most, F.raise_error(message).cast("double")).otherwise(value)
        out.append(value.alias(f.name, metadata=f.metadata))
    return df.select(*out)


def cut_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns with text cut to size, numbers and nulls untouched."""
    return df.select(
        *[
            (
                cut_bytes(F.col(f.name).cast("string"), Attribute(f.name, **f.metadata).bytes)
                if isinstance(f.dataType, T.StringType)
                else F.col(f.name)
            ).alias(f.name, metadata=f.metadata)
            for f in schema.fields
        ]
    )
