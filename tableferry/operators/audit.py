"""Manifests, checksums and table fingerprints. Every measure is a partial-then-final aggregate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import MAX_CODEC_NUMBER
from ..session import work_dir


@F.arrow_udf(T.IntegerType())
def xor_of_bytes(payloads: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """XOR of all bytes of each binary value; 0 for an empty one and for null. Works on the batch's bytes as they lie."""
    for payload in payloads:
        payload = payload.fill_null(b"")
        _, offsets, data = payload.buffers()
        ends = np.frombuffer(offsets, np.int32)[payload.offset : payload.offset + len(payload) + 1]
        out, filled = np.zeros(len(payload), np.int32), np.diff(ends) > 0
        if filled.any():
            # neighbouring runs: a run ends where the next filled one begins
            flat = np.frombuffer(data, np.uint8)[: ends[-1]]
            out[filled] = np.bitwise_xor.reduceat(flat, ends[:-1][filled])
        yield pa.array(out)


def byte_checksum(line: Column) -> Column:
    """Aggregate: XOR over every byte of every line. Order and grouping of rows do not matter."""
    return F.bit_xor(xor_of_bytes(line.cast("binary")))


def crc_checksums(df: DataFrame, line: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Order-free combination of the lines' CRC-32: count, XOR and sum."""
    crc = F.crc32(line.cast("binary"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("tuples"),
        F.bit_xor(crc).alias("crc_xor"),
        F.sum(crc.cast("decimal(20,0)")).cast("decimal(38,0)").alias("crc_sum"),
    )


def block_manifest(blocks: DataFrame, line: Column, layout: int, codec: int) -> DataFrame:
    """One row per block: tuples, payload bytes (newline included), layout and codec number."""
    return blocks.groupBy("block").agg(
        F.count("*").alias("tuples"),
        F.sum(F.octet_length(line) + 1).alias("bytes"),
        F.lit(layout).alias("layout"),
        F.lit(codec).alias("codec"),
    )


def manifest_violations(manifest: DataFrame, max_tuples: int, max_bytes: int) -> DataFrame:
    """Blocks that are too long, too large or carry an unknown codec, with the reasons."""
    reasons = F.concat_ws(
        ",",
        F.when(F.col("tuples") > max_tuples, "tuples"),
        F.when(F.col("bytes") > max_bytes, "bytes"),
        F.when(F.col("codec") > MAX_CODEC_NUMBER, "codec"),
    )
    return manifest.withColumn("reasons", reasons).filter(F.col("reasons") != "")


LANE_BITS = 21  # three lanes of a 64-bit hash; the sum of one fits 64 bits for 4e12 rows
LANES = ("lane0", "lane1", "lane2")
ROW = ""  # stands for the whole row among the columns' names


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, rows, values`` and three sums of hash parts, for each column and, under ``ROW``, for whole rows.

    The sums do not depend on the order of rows and add up: the fingerprint of a table with appended files is that of the
    table ``merged`` with that of the files. They tell pairs and swaps that an XOR would miss. ``df`` is read once; each
    row is a few hashes, and summing them is a partial-then-final aggregate with one row a column.
    """
    columns = list(columns or df.columns)
    each = [(c, F.col(c).isNotNull(), F.xxhash64(F.col(c))) for c in columns]
    each.append((ROW, F.lit(True), F.xxhash64(*[F.col(c) for c in columns])))
    hashes = F.array(*[F.struct(F.lit(n).alias("column"), there.alias("there"), h.alias("hash")) for n, there, h in each])
    parts = [F.shiftright("hash", LANE_BITS * i).bitwiseAND((1 << LANE_BITS) - 1) for i in range(3)]
    return df.select(F.inline(hashes)).groupBy("column").agg(
        F.count("*").alias("rows"), F.count_if("there").alias("values"), *[F.sum(p).alias(n) for p, n in zip(parts, LANES)]
    )


def merged(*fingerprints: DataFrame) -> DataFrame:
    """The fingerprint of several tables as one."""
    return reduce(DataFrame.unionByName, fingerprints).groupBy("column").agg(
        *[F.sum(n).alias(n) for n in ("rows", "values", *LANES)]
    )


def fingerprint_path(path: str) -> str:
    """Where a table's fingerprint is kept: beside the table, in a folder that readers of it leave out."""
    return f"{path.rstrip('/')}/_fingerprint"


def keep_fingerprint(df: DataFrame, path: str) -> DataFrame:
    """Writes the fingerprint of the table at ``path`` beside it, in the columns and types of ``df``."""
    fingerprint(df).coalesce(1).write.mode("overwrite").parquet(fingerprint_path(path))
    return kept_fingerprint(df.sparkSession, path)


def kept_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(fingerprint_path(path))


def compared(original: DataFrame, copies: dict[str, DataFrame]) -> DataFrame:
    """Accept or reject copies by their fingerprints: one row per copy and column, as in ``verify_copy``."""
    sides = reduce(DataFrame.unionByName, [df.withColumn("copy", F.lit(name)) for name, df in copies.items()])
    a, b = original.alias("a"), sides.alias("b")
    both = a.join(b, F.col("a.column") == F.col("b.column"), "left")
    same = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in ("rows", "values", *LANES)]
    each = both.select(
        F.col("b.copy").alias("copy"), F.col("a.column").alias("column"), F.col("a.rows").alias("rows_a"),
        F.col("b.rows").alias("rows_b"), reduce(and_, same).alias("same_values"),
    )
    # an empty table has no rows to hash, and so an empty fingerprint: copies are named by the caller
    whole = each.filter(F.col("column") == ROW).select("copy", F.col("same_values").alias("same_rows"))
    checked = each.filter(F.col("column") != ROW).join(F.broadcast(whole), "copy")  # one row a copy
    return checked.select(
        "copy", "column", "rows_a", "rows_b", "same_rows", "same_values",
        ((F.col("rows_a") == F.col("rows_b")) & F.col("same_rows") & F.col("same_values")).alias("accepted"),
    )


def verify_copies(original: DataFrame, copies: dict[str, DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """Each copy against the original: every table is read once, whatever the number of copies.

    A copy is seen in the original's types, so that a column that grew from 32 to 64 bits on the way still compares.
    """
    columns = list(columns or original.columns)

    def seen(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).try_cast(original.schema[c].dataType).alias(c) for c in columns])

    # One row a column and table; written, so that the original is not read again for every copy.
    sides = [fingerprint(original, columns).withColumn("copy", F.lit(None).cast("string"))]
    sides += [fingerprint(seen(df), columns).withColumn("copy", F.lit(name)) for name, df in copies.items()]
    spark, path = original.sparkSession, work_dir(original.sparkSession, "fingerprints")
    reduce(DataFrame.unionByName, sides).write.parquet(path)
    found = spark.read.schema(sides[0].schema).parquet(path)
    none = spark.createDataFrame(
        [(c, name) for name in (None, *copies) for c in (*columns, ROW)], "column string, copy string"
    ).select("column", *[F.lit(0).cast("long").alias(n) for n in ("rows", "values", *LANES)], "copy")
    every = found.unionByName(none).groupBy("copy", "column").agg(*[F.sum(n).alias(n) for n in ("rows", "values", *LANES)])
    return compared(
        every.filter("copy is null").drop("copy"),
        {name: every.filter(F.col("copy") == name).drop("copy") for name in copies},
    )


def verify_copy(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Accept or reject one copy: one row per column, and ``accepted`` only if everything agrees."""
    return verify_copies(a, {"": b}, columns).drop("copy")


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that occur more often on one side, with how often, as multisets.

    Both sides are counted before they meet, so copies of one row cost one row.
    """
    tagged = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    surplus = tagged.groupBy(*a.columns).agg(F.sum("_n").alias("surplus"))
    return surplus.filter(F.col("surplus") != 0)
