"""Exact quantiles by selection: nothing is sorted but the few values around a wanted rank.

One pass gives each group a mergeable rank sketch, which names two values that enclose every wanted
rank. A second pass over the same two or three columns counts, exactly, the rows below each pair and
keeps the distinct values inside it with their counts; all other rows of a group become one row
before anything is shuffled. So some thousandths of a group travel on, and a value that a third of all
rows share is one row. Should a bracket still hold many values, a histogram of it names a smaller
one, as often as needed. The sketch only decides how much is kept: a bracket that misses its rank is
noticed by the counts and replaced by the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir

SKETCH = 10_000  # the sketch is off by at most one rank in so many
MARGIN = 4 / SKETCH  # of the ranks, kept on both sides of a wanted one
KEPT = 1 << 16  # distinct values of one bracket that are put in order by one task
BUCKETS = 4_096


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _groups(rows: DataFrame, keys: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """One row per group: its size and extremes, and the brackets ``lo`` and ``hi``, one for each quantile."""
    points = [x for p in probabilities.values() for x in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        F.percentile_approx("_v", points, SKETCH).alias("_near"),
    )

    def bound(i: int, end: str, sure: bool) -> Column:
        # a group smaller than the sketch, and a rank near an end, are enclosed by the extremes
        return F.col(end) if sure else F.when(F.col("n") < SKETCH, F.col(end)).otherwise(F.col("_near")[i])

    lo = [bound(2 * i, "min", p <= MARGIN) for i, p in enumerate(probabilities.values())]
    hi = [bound(2 * i + 1, "max", p >= 1 - MARGIN) for i, p in enumerate(probabilities.values())]
    return _written(
        found.select(
            F.monotonically_increasing_id().alias("_g"), *keys, "n", "min", "max", F.array(*lo).alias("lo"), F.array(*hi).alias("hi")
        ),
        "quantile-groups",
    )


def _counted(rows: DataFrame, groups: DataFrame, keys: Sequence[str], number: int) -> DataFrame:
    """Per group: each distinct value inside a bracket (null for all others) with its count, and the rows that lie
    below each bracket."""
    of_group = groups.select("_g", "lo", "hi", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    near = rows.join(of_group, same)
    inside = reduce(or_, [F.col("_v").between(F.col("lo")[i], F.col("hi")[i]) for i in range(number)])
    counted = near.groupBy("_g", F.when(inside, F.col("_v")).alias("_v")).agg(
        F.count("*").alias("_c"),
        *[F.count_if(F.col("_v") < F.col("lo")[i]).alias(f"_below{i}") for i in range(number)],
    )
    return _written(counted, "quantile-values")


def _brackets(groups: DataFrame, counted: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """One row per (group, quantile): ranks, bounds, rows below, and whether the counts enclose the ranks."""
    sums = [F.sum(f"_below{i}").alias(f"_below{i}") for i in range(len(probabilities))]
    spots = F.array(
        *[
            F.struct(
                F.lit(q).alias("q"), F.lit(float(p)).alias("p"), F.col("lo")[i].alias("lo"), F.col("hi")[i].alias("hi"),
                F.col(f"_below{i}").alias("below"),
            )
            for i, (q, p) in enumerate(probabilities.items())
        ]
    )
    each = groups.join(counted.groupBy("_g").agg(*sums), "_g").select("_g", "n", F.inline(spots))
    exact = F.col("p") * (F.col("n") - 1)
    return each.withColumns({"r0": F.floor(exact), "r1": F.ceil(exact), "share": exact - F.floor(exact)})


def _values(counted: DataFrame, brackets: DataFrame) -> DataFrame:
    near = counted.filter(F.col("_v").isNotNull()).select("_g", "_v", "_c").join(brackets, "_g")
    return near.filter(F.col("_v").between(F.col("lo"), F.col("hi")))


def _judged(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """Per (group, quantile): how many values its bracket holds, and whether they miss its ranks."""
    held = values.groupBy("_g", "q").agg(F.sum("_c").alias("held"), F.count("*").alias("kept"))
    both = brackets.join(held, ["_g", "q"], "left")
    wrong = (F.col("below") > F.col("r0")) | (F.col("below") + F.coalesce("held", F.lit(0)) <= F.col("r1"))
    return both.select("_g", "q", F.coalesce("kept", F.lit(0)).alias("kept"), wrong.alias("missed"))


def _narrowed(values: DataFrame) -> DataFrame:
    """The values in smaller brackets: the buckets, of ``BUCKETS`` equal parts of each, that hold the wanted ranks."""
    low, width = F.col("lo").cast("double"), F.col("hi").cast("double") - F.col("lo").cast("double")
    share = F.try_divide(F.col("_v").cast("double") - low, width)  # null where all values are one
    bucket = F.coalesce(F.floor(share * BUCKETS), F.lit(0).cast("long"))
    ranks = ["n", "p", "below", "r0", "r1", "share"]
    parts = values.groupBy("_g", "q", *ranks, bucket.alias("bucket")).agg(
        F.sum("_c").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
    )
    before = Window.partitionBy("_g", "q").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)))
    wanted = parts.filter((F.col("start") <= F.col("r1")) & (F.col("start") + F.col("c") > F.col("r0")))
    smaller = wanted.groupBy("_g", "q", *[r for r in ranks if r != "below"]).agg(
        F.min("start").alias("below"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    kept = values.select("_g", "q", "_v", "_c").join(smaller, ["_g", "q"])
    return _written(kept.filter(F.col("_v").between(F.col("lo"), F.col("hi"))), "quantile-values")


def _largest(values: DataFrame) -> int:
    return values.groupBy("_g", "q").count().agg(F.max("count")).first()[0] or 0


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, with min, max and count; null values are left out.

    ``df`` is read twice, in the columns named here only. The returned rows read the kept values.
    """
    rows = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    groups = _groups(rows, keys, probabilities)
    counted = _counted(rows, groups, keys, len(probabilities))
    brackets = _brackets(groups, counted, probabilities)
    values = _values(counted, brackets)
    judged = _judged(values, brackets)
    most, missed = judged.agg(F.max("kept"), F.coalesce(F.max("missed"), F.lit(False))).first()  # two numbers
    if missed:
        whole = groups.join(judged.filter("missed").select("_g", F.lit(True).alias("_whole")).distinct(), "_g", "left")

        def widened(name: str, end: str) -> Column:
            return F.when(F.col("_whole"), F.transform(name, lambda _: F.col(end))).otherwise(F.col(name)).alias(name)

        groups = _written(whole.select("_g", *keys, "n", "min", "max", widened("lo", "min"), widened("hi", "max")), "quantile-groups")
        counted = _counted(rows, groups, keys, len(probabilities))
        values = _values(counted, _brackets(groups, counted, probabilities))
        most = _largest(values)
    while (most or 0) > KEPT:
        values = _narrowed(values)
        most, before = _largest(values), most
        if most >= before:  # values a histogram cannot part, such as infinite ones
            break
    so_far = Window.partitionBy("_g", "q").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("until", F.col("below") + F.sum("_c").over(so_far))
    found = ranked.groupBy("_g", "q", "share").agg(
        F.min(F.when(F.col("until") > F.col("r0"), F.col("_v"))).alias("low"),
        F.min(F.when(F.col("until") > F.col("r1"), F.col("_v"))).alias("high"),
    )
    between = F.when(F.col("share") == 0, F.col("low")).otherwise(
        F.col("low") * (1 - F.col("share")) + F.col("high") * F.col("share")
    )
    wide = found.groupBy("_g").agg(*[F.max(F.when(F.col("q") == q, between)).alias(q) for q in probabilities])
    return groups.select("_g", *keys, "n", "min", "max").join(wide, "_g").drop("_g")
