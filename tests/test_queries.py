import pytest

import __spark_entry__ as contract
from tests.compare import database, rows_of

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db(small):
    return database(small)


CORPUS = ("op", "pipeline")  # queries of the corpus operators, whose own tests compare those SQL cannot express


def test_every_checking_statement_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
    assert all(name.startswith(CORPUS) for name in set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    df = QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # No product of two tables, and nothing compared pair by pair.
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in ORACLES:
        assert df.columns
        return
    ours = df.toPandas()
    theirs = db.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_flagship(spark, small):
    assert contract.entry(spark).first()["totalcnt"] == spark.read.parquet(f"{small}/lineitem.parquet").count()


def test_scan_reads_only_what_is_needed(spark, small):
    plan = QUERIES["agg1_first_attribute_stats"](spark, small)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_crc_matches_python(spark, small):
    import zlib

    from tableferry.functions.fixed_text import csv_line
    from tableferry.queries.derived import LINEITEM, lineitem

    lines = [r[0] for r in lineitem(spark, small).select(csv_line(LINEITEM)).collect()]
    got = QUERIES["aud4_crc32"](spark, small).toPandas()
    assert sum(int(v) for v in got["crc_sum"]) == sum(zlib.crc32(t.encode()) for t in lines)
