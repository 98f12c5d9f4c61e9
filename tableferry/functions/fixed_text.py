"""Text of fixed-size fields: cutting, padding and the fixed CSV line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUL = "\x00"


def cut_bytes(value: Column, size: int) -> Column:
    """Text up to the first NUL, at most ``size`` bytes (bytes, not characters)."""
    head = F.substring_index(value, NUL, 1)
    cut = F.substring(head.cast("binary"), 1, size).cast("string")
    return F.when(F.octet_length(head) > size, cut).otherwise(head)


def pad_bytes(value: Column, size: int) -> Column:
    """Fixed-width image of a string: cut to ``size`` bytes, then padded with NUL to that size."""
    cut = cut_bytes(value, size)
    return F.concat(cut, F.repeat(F.lit(NUL), F.lit(size) - F.octet_length(cut)))


def two_decimals(value: Column) -> Column:
    """``%.2f`` as C prints it: the exact binary value rounded half-even, no grouping.

    Away from a tie every way of rounding agrees, so whole hundredths are printed as two integers.
    Values near a tie, close to zero or too large for exact hundredths take the number formatter.
    The expression is kept short: four of them in one line must still compile to machine code.
    """
    scaled = F.abs(value) * 100
    certain = scaled.between(1.0, 1e13) & (F.abs(scaled - F.rint(scaled)) < 0.49)
    cents = F.rint(scaled).cast("bigint")
    digits = F.concat(
        F.when(value < 0, "-").otherwise(""),
        F.floor(cents / 100).cast("string"),
        F.lit("."),
        F.substring((cents % 100 + 100).cast("string"), 2, 2),
    )
    slow = F.call_function("format_number", value, F.lit("0.00"))
    slow = F.lower(F.replace(slow, F.lit("\u221e"), F.lit("inf")))
    return F.when(certain, digits).otherwise(slow)


def csv_field(field: T.StructField) -> Column:
    value = F.col(field.name)
    kind = field.metadata["type"]
    if kind == "INT":
        return value.cast("string")
    if kind == "DOUBLE":
        return two_decimals(value)
    return cut_bytes(value.cast("string"), 1 if kind == "CHAR" else field.metadata["size"])


def csv_line(schema: T.StructType) -> Column:
    """One text line per row: comma between fields, no header, quotes or escapes.

    A null has no image in the line format; ``concat_ws`` would silently shift the columns, so it
    becomes an empty field.
    """
    return F.concat_ws(",", *[F.coalesce(csv_field(f), F.lit("")) for f in schema.fields])
