import json

import pytest

from tableferry import enforce_schema, schema_from_json, struct_of
from tableferry.schema import attributes_of, max_text_row, row_bytes, rows_per_block

LINEITEM = [
    ("l_orderkey", "INT", 4), ("l_partkey", "INT", 4), ("l_suppkey", "INT", 4), ("l_linenumber", "INT", 4),
    ("l_quantity", "DOUBLE", 8), ("l_extendedprice", "DOUBLE", 8), ("l_discount", "DOUBLE", 8), ("l_tax", "DOUBLE", 8),
    ("l_returnflag", "CHAR", 1), ("l_linestatus", "CHAR", 1), ("l_shipdate", "STRING", 11),
    ("l_commitdate", "STRING", 11), ("l_receiptdate", "STRING", 11), ("l_shipinstruct", "STRING", 26),
    ("l_shipmode", "STRING", 11), ("l_comment", "STRING", 45),
]
WIDE = [(f"c{i}", "INT", 4) for i in range(230)]


def as_json(path, attributes):
    path.write_text(json.dumps([{"name": n, "type": t, "size": s} for n, t, s in attributes]))
    return str(path)


@pytest.mark.parametrize(
    "attributes, size, small, large",
    [(LINEITEM, 165, 397, 6355), (LINEITEM[:8], 48, 1365, 21845), (WIDE, 920, 71, 1139)],
)
def test_row_and_block_sizes(tmp_path, attributes, size, small, large):
    schema = schema_from_json(as_json(tmp_path / "t.json", attributes))
    assert [tuple(a) for a in attributes_of(schema)] == attributes
    assert row_bytes(schema) == size
    assert rows_per_block(schema, 64) == small
    assert rows_per_block(schema, 1024) == large


def test_schema_through_spark(spark, tmp_path):
    path = as_json(tmp_path / "t.json", LINEITEM)
    assert schema_from_json(path, spark) == schema_from_json(path)


def test_missing_schema_file(tmp_path):
    with pytest.raises(FileNotFoundError):
        schema_from_json(str(tmp_path / "absent.json"))


@pytest.mark.parametrize("attribute", [("a", "DATE", 4), ("a", "CHAR", 0)])
def test_bad_attributes(attribute):
    with pytest.raises(ValueError):
        struct_of([attribute])


def test_text_width():
    assert max_text_row(struct_of([("a", "INT", 4), ("b", "DOUBLE", 8), ("c", "CHAR", 1), ("d", "STRING", 5)])) == 44


@pytest.mark.parametrize("value", [None, 2**31, -(2**31) - 1])
def test_values_that_do_not_fit_fail(spark, value):
    df = spark.createDataFrame([(value,)], "a bigint")
    with pytest.raises(Exception, match="does not fit"):
        enforce_schema(df, struct_of([("a", "INT", 4)])).collect()


def test_wide_ints_keep_large_keys(spark):
    df = spark.createDataFrame([(2**40,)], "a bigint")
    assert enforce_schema(df, struct_of([("a", "INT", 4)], wide_ints=True)).first()[0] == 2**40


def test_text_is_cut_to_size(spark):
    df = spark.createDataFrame([("AB", "abc\0def", "xyzxyz")], "a string, b string, c string")
    schema = struct_of([("a", "CHAR", 1), ("b", "STRING", 9), ("c", "STRING", 4)])
    assert tuple(enforce_schema(df, schema).first()) == ("A", "abc", "xyzx")
