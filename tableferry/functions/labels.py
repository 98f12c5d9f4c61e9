"""Labels, category orders and recodes used in reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def relabel(value: Column, labels: Mapping) -> Column:
    """Mapped value where the mapping has one, otherwise the value itself."""
    out = F.when(F.lit(False), value)
    for old, new in labels.items():
        out = out.when(value == old, F.lit(new))
    return out.otherwise(value)


def lookup(value: Column, table: Mapping) -> Column:
    """Mapped value, null where the mapping has none. For fixed tables of a few rows."""
    out = F.when(F.lit(False), F.lit(None))
    for key, mapped in table.items():
        out = out.when(value == key, F.lit(mapped))
    return out


def strict_lookup(value: Column, table: Mapping) -> Column:
    """Mapped value; a value that the mapping does not have fails the job."""
    missing = F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(value.cast("string"), F.lit("null"))))
    return F.coalesce(lookup(value, table), missing)


def category_rank(value: Column, order: Sequence[str]) -> Column:
    """0-based place in a custom order; null for a value outside it."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.nullif(place, F.lit(0)) - 1


def first_then_sorted(value: Column, first: str) -> list[Column]:
    """Sort keys: one value in front, the others by name."""
    return [(value != first).asc(), value.asc()]


def unlimited_last(value: Column) -> list[Column]:
    """Sort keys: 0 means unlimited and goes to the end."""
    return [(value == 0).asc(), value.asc()]


def network_label(network: Column) -> Column:
    return F.when(network == 0, F.lit("local")).otherwise(network.cast("string"))


def last_part(value: Column, sep: str = "-") -> Column:
    return F.element_at(F.split(value, sep), -1)


def environment_label(client_cpu: Column, server_cpu: Column, network: Column) -> Column:
    return F.concat(
        F.lit("C"), client_cpu.cast("string"),
        F.lit(" S"), server_cpu.cast("string"),
        F.lit(" N"), network.cast("string"),
    )


def layout_label(layout: Column) -> Column:
    return F.when(layout == 1, "row").when(layout == 2, "col").otherwise(layout.cast("string"))


def codec_layout_label(codec: Column, layout: Column) -> Column:
    """``snappy(row)`` / ``snappy(col)``: everything that is not row layout counts as column."""
    return F.concat(codec, F.when(layout == 1, "(row)").otherwise("(col)"))


def parse_environment(key: Column) -> dict[str, Column]:
    """``16-2-125-0-0`` -> server and client CPUs, network rate, latency and loss as integers."""
    names = ("server_cpu", "client_cpu", "network", "network_latency", "network_loss")
    parts = F.split(key, "-")
    return {name: F.get(parts, i).cast("int").alias(name) for i, name in enumerate(names)}
