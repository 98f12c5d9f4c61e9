"""Arithmetic on rates, sizes and loads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import SERIAL_SHARE


def effective_rate(base: Column, workers: Column, serial_share: float = SERIAL_SHARE) -> Column:
    """Rate of a stage with that many workers, part of it serial."""
    return (F.lit(serial_share) + F.lit(1 - serial_share) * workers) * base


def serial_fraction(single: Column, overall: Column, workers: Column) -> Column:
    """Share of the work that does not scale, clamped to 0..1; 0 for one worker.

    ``single`` is the rate with one worker, ``overall`` the total rate with ``workers``. Without
    a single-worker rate the share is unknown, which the clamp alone would turn into 1.
    """
    share = F.try_divide(single * workers - overall, single * (workers - 1))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.when(workers == 1, F.lit(0.0)).when(share.isNotNull(), clamped)


def real_throughput(size: Column, runtime: Column) -> Column:
    return F.try_divide(size, runtime)


def percent_error(estimated: Column, real: Column) -> Column:
    return F.try_divide(F.abs(estimated - real), F.abs(real)) * 100


def slowest_rate(*rates: Column) -> Column:
    """Smallest non-zero rate; null when all are zero."""
    return F.least(*[F.nullif(r, F.lit(0.0)) for r in rates])


def wait_share(waiting: Column, active: Column) -> Column:
    """Part of the time spent waiting; 0 when nothing was measured."""
    return F.coalesce(F.try_divide(waiting, waiting + active), F.lit(0.0))


def normalised_cpu(average: Column, cores: Column) -> Column:
    """Percent of the allowed CPUs, two decimals of the exact binary value, ties to even."""
    return F.call_function("format_number", average / (cores * 100) * 100, F.lit("0.00")).cast("double")


def megabytes(size: Column) -> Column:
    return size * F.lit(1e-6)


def gibibytes(size: Column) -> Column:
    return size / F.lit(1024.0**3)
