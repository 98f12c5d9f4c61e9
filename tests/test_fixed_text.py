import random

from pyspark.sql import functions as F

from tableferry import struct_of
from tableferry.functions.fixed_text import csv_line, cut_bytes, pad_bytes, two_decimals


def test_two_decimals_print_like_c(spark):
    rng = random.Random(7)
    values = [0.125, 0.375, 1.005, 2.675, 0.005, -0.001, -0.0, 0.0, 0.01, -0.07, 99.995, 1e15, 123456789012.345,
              float("nan"), float("inf"), float("-inf"), 0.045, -2.5, 1e11, 4.35, 1.115]
    values += [rng.uniform(-1e6, 1e6) for _ in range(500)]
    values += [rng.randrange(-100000, 100000) / 1000 for _ in range(1000)]
    values += [rng.randrange(-10**6, 10**6) / 8 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shown = df.select("v", two_decimals(F.col("v")).alias("t")).collect()
    assert [r.t for r in shown] == ["%.2f" % v for v in values]


def test_cut_counts_bytes(spark):
    df = spark.createDataFrame([("äöü",), ("abc",), ("",), ("a\0b",)], "v string")
    cut = [bytes(r[0]) for r in df.select(cut_bytes(F.col("v"), 3).cast("binary")).collect()]
    assert cut == ["äö".encode()[:3], b"abc", b"", b"a"]


def test_padding(spark):
    df = spark.createDataFrame([("ab",), ("abcdef",)], "v string")
    assert [r[0] for r in df.select(pad_bytes(F.col("v"), 4)).collect()] == ["ab\0\0", "abcd"]


def test_line_keeps_columns_in_place(spark):
    schema = struct_of([("a", "INT", 4), ("b", "DOUBLE", 8), ("c", "CHAR", 1), ("d", "STRING", 3)])
    df = spark.createDataFrame([(1, 2.0, "x", "long"), (None, None, None, None)], "a int, b double, c string, d string")
    assert [r[0] for r in df.select(csv_line(schema)).collect()] == ["1,2.00,x,lon", ",,,"]
