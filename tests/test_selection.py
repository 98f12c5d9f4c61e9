import numpy as np
import pytest
from pyspark.sql import functions as F

from tableferry.operators import selection

WANTED = {"lo": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.9, "hi": 1.0}


@pytest.fixture(scope="module")
def skewed(spark):
    """30,000 rows: a third of them of one key, a third of that with one value, holes, two small keys and a null key."""
    return spark.range(30_000).selectExpr(
        "id",
        "case when id % 7 = 0 then null when id % 9 = 0 then 5.0D else cast((id * 7919) % 10007 as double) / 8 end v",
        "case when id % 3 = 0 then 'hot' when id = 1 then 'one' when id < 5 then 'few' when id % 5 = 0 then null "
        "else concat('k', id % 4) end k",
    )


def _plain(df):
    groups = {}
    for r in df.collect():
        if r.v is not None:
            groups.setdefault(r.k, []).append(r.v)
    return groups


def _same(df, found):
    groups = _plain(df)
    assert {r.k for r in found} == set(groups) and len(found) == len(groups)
    for r in found:
        own = groups[r.k]
        assert np.allclose([r[q] for q in WANTED], np.quantile(own, list(WANTED.values())), rtol=0, atol=1e-9)
        assert (r.n, r.min, r.max) == (len(own), min(own), max(own))


def test_quantiles_equal_numpy(skewed):
    _same(skewed, selection.quantiles(skewed, ["k"], "v", WANTED).collect())


def test_brackets_keep_little(spark):
    df = spark.range(200_000).selectExpr("cast((id * 7919) % 200003 as double) v", "'x' k")
    rows = df.withColumnRenamed("v", "_v")
    kept = selection._counted(rows, selection._groups(rows, ["k"], {"q": 0.5}), ["k"], 1)
    assert kept.count() < 400
    _same(df, selection.quantiles(df, ["k"], "v", WANTED).collect())


def test_missed_brackets_are_noticed(skewed, monkeypatch):
    monkeypatch.setattr(selection, "SKETCH", 4)  # far too coarse, with a margin that does not allow for it
    monkeypatch.setattr(selection, "MARGIN", 0.0001)
    _same(skewed, selection.quantiles(skewed, ["k"], "v", WANTED).collect())


def test_large_brackets_are_narrowed(skewed, monkeypatch):
    monkeypatch.setattr(selection, "KEPT", 6)
    monkeypatch.setattr(selection, "BUCKETS", 8)
    _same(skewed, selection.quantiles(skewed, ["k"], "v", WANTED).collect())


def test_awkward_values(spark):
    df = spark.createDataFrame([("a", float("inf")), ("a", 1.0), ("a", float("-inf")), ("b", None), ("c", 2.0)], "k string, v double")
    found = {r.k: (r.n, r.q) for r in selection.quantiles(df, ["k"], "v", {"q": 0.5}).collect()}
    assert found == {"a": (3, 1.0), "c": (1, 2.0)}
    assert selection.quantiles(df.limit(0), ["k"], "v", {"q": 0.5}).count() == 0


def test_nothing_is_sorted_but_what_is_kept(skewed):
    plan = selection.quantiles(skewed, ["k"], "v", WANTED)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "NestedLoop" not in plan
    assert all("quantile-" in x for x in plan.split("Location: ")[1:])
