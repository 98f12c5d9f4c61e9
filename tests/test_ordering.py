import pytest
from pyspark.sql import functions as F

from tableferry.operators import dedup, ordering, ranking, slices, summarize


@pytest.fixture(scope="module")
def skewed(spark):
    """900 rows, a third of them with one value and one key."""
    return spark.range(900).selectExpr(
        "id", "if(id % 3 = 0, 5.0D, cast(id as double)) v", "if(id % 3 = 0, 'hot', concat('k', id % 10)) k"
    )


def test_positions_follow_the_order(spark, skewed):
    got = ordering.with_position(skewed, ["v", "id"], partitions=5).orderBy("position").collect()
    rows = sorted(map(tuple, skewed.collect()), key=lambda r: (r[1], r[0]))
    assert [tuple(r)[:3] for r in got] == rows
    assert [r.position for r in got] == list(range(900))


def test_a_hot_value_is_spread_over_partitions(skewed):
    ranged = skewed.repartitionByRange(6, "v", "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranged) < 300


@pytest.mark.parametrize("parts", [1, 7, 900, 1000])
def test_contiguous_parts(skewed, parts):
    got = ordering.split_contiguous(skewed, parts, ["v", "id"]).groupBy("part").count().collect()
    size = -(-900 // parts)
    counts = {r.part: r["count"] for r in got}
    assert counts == {i: min(size, 900 - i * size) for i in range(-(-900 // size))}


def test_curve_leaves_out_what_is_not_positive(spark):
    df = spark.createDataFrame([(3.0,), (0.0,), (-1.0,), (8.0,), (5.0,)], "time double")
    assert [(r.idx, r.time) for r in ordering.descending_curve(df, "time").orderBy("idx").collect()] == [
        (0, 8.0), (1, 5.0), (2, 3.0)]


def test_first_rows_come_in_order(skewed):
    found = ranking.first_rows(skewed, 50, ["v", "id"]).select("v", "id").collect()
    everything = sorted((r.v, r.id) for r in skewed.select("v", "id").collect())
    assert [tuple(r) for r in found] == everything[:50]


def test_positions_with_files_that_roll_over(spark, skewed):
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "10")
    try:
        found = ordering.with_position(skewed, ["v", "id"]).select("position", "v", "id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    assert [r.position for r in sorted(found)] == list(range(len(found)))
    assert [(r.v, r.id) for r in sorted(found)] == sorted((r.v, r.id) for r in found)


def test_duplicates_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4), ("b", 5)], "k string, v int")
    assert sorted(r.v for r in dedup.first_per_key(df, ["k"], ["v"]).collect()) == [1, 3, 4]
    assert sorted(r.v for r in dedup.duplicate_members(df, ["k"]).collect()) == [1, 2, 4, 5]
    counts = dedup.cleaning_counts(df, F.col("v") > 1, ["k"]).first()
    assert tuple(counts) == (5, 1, 1, 3)


def test_hot_duplicates_stay_whole(spark):
    """2,000 copies of one key, 2,000 single keys and 1,000 pairs: hot and other keys both occur."""
    df = spark.range(6000).selectExpr(
        "id", "case when id < 2000 then 'hot' when id < 4000 then concat('s', id) else concat('p', id div 2) end k"
    )
    got = sorted(r.id for r in dedup.duplicate_members(df, ["k"]).collect())
    assert got == [*range(2000), *range(4000, 6000)]


def test_append_keeps_or_drops_repeats_inside_the_batch(spark):
    old = spark.createDataFrame([(1,)], "id int")
    new = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert [r.id for r in dedup.append_new(old, new, "id").collect()] == [2, 2]
    assert [r.id for r in dedup.append_new(old, new, "id", unique_in_batch=True).collect()] == [2]


def test_set_difference_ignores_measured_columns(spark):
    wanted = spark.createDataFrame([(1, "a"), (2, None)], "p int, c string")
    recorded = spark.createDataFrame([(2, None, 9.0)], "p int, c string, time double")
    assert [tuple(r) for r in dedup.missing_configs(wanted, recorded, ["time"]).collect()] == [(1, "a")]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "v bigint")
    assert tuple(summarize.first_attribute_stats(empty, "v").first()) == (0, 0, None, None, None, None)
    assert tuple(summarize.average_load(empty, ["v"]).first()) == (0.0,)


def test_sum_does_not_overflow(spark):
    df = spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "v bigint")
    assert summarize.first_attribute_stats(df, "v").first()["sum"] == 3 * 2**62


def test_unreadable_samples_count_in_the_mean(spark):
    df = spark.createDataFrame([("a", "10.5"), ("a", "--"), ("a", "1e3"), ("b", "x")], "h string, cpu string")
    got = {r.h: r.average_cpu for r in summarize.average_cpu(df, ["h"], "cpu").collect()}
    assert got == {"a": 3.5, "b": 0.0}


def test_slices_use_one_pass_over_deviations(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (2, 1, 8.0), (1, 4, 7.0), (2, 4, 5.0)], "a int, b int, time double")
    got = {(r.param, r.level, r.time) for r in slices.one_at_a_time(df, {"a": 1, "b": 1}).collect()}
    assert got == {("a", 1.0, 10.0), ("b", 1.0, 10.0), ("a", 2.0, 8.0), ("b", 4.0, 7.0)}


def test_serial_fraction_is_clamped(spark):
    df = spark.createDataFrame(
        [("read", 1, 10.0), ("read", 2, 10.0), ("read", 4, 1.0), ("send", 2, 5.0)],
        "component string, parallelism int, throughput double",
    )
    got = {(r.component, r.parallelism): r.s for r in summarize.serial_fractions(df).collect()}
    assert got[("read", 1)] == 0 and got[("read", 2)] == 0 and got[("read", 4)] == 1
    # without a single-worker baseline nothing is known, and the clamp must not hide that
    assert got[("send", 2)] is None
