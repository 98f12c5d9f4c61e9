"""Best settings within worker caps: exhaustive search and worker allocation.

Both are computed inside each row from short arrays (stages x workers), so they need no join and no
window, and only the choice between codecs is an aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CLIENT_STAGES, CODECS, SERVER_STAGES, STAGES
from ..functions.labels import category_rank
from ..functions.rates import effective_rate

SEARCHED = ("read", "deser", "comp", "decomp", "ser")  # send, rcv and write stay at one worker


def _rate_list(stage: str, cap: Column) -> Column:
    """Rates with 1, 2, ... cap workers: strictly rising unless the base rate is zero."""
    return F.transform(F.sequence(F.lit(1), cap), lambda w: effective_rate(F.col(stage), w))


def grid_search(
    df: DataFrame,
    keys: Sequence[str],
    codec: str = "compression",
    bound: str = "bound",
    server_cap: str = "server_cap",
    client_cap: str = "client_cap",
) -> DataFrame:
    """Best settings per key over codecs and worker counts, as if every combination had been tried.

    Searched: read + deser + comp + send <= server cap, rcv + decomp + ser <= client cap, with send,
    rcv and write at one worker. The highest throughput not above the bound wins, and the first in
    loop order (codec, then read, deser, comp, decomp, ser rising) on ties.

    Throughput is the smallest non-zero rate, so it equals some stage's rate for some worker count.
    For such a value every stage needs at least the workers that reach it; those minimal counts are
    also the first combination in loop order with that throughput. So it is enough to test one
    combination per (stage, workers) instead of all products. A setting with an unmeasured stage
    cannot be judged and is left out.
    """
    caps = {s: F.col(server_cap) if s in SERVER_STAGES else F.col(client_cap) for s in SEARCHED}
    possible = df.dropna(subset=list(STAGES)).filter((F.col(server_cap) >= 4) & (F.col(client_cap) >= 3))
    rates = possible.withColumns({f"_{s}": _rate_list(s, caps[s]) for s in SEARCHED})
    fixed = F.array(*[effective_rate(F.col(s), F.lit(1)) for s in ("send", "rcv", "write")])
    targets = F.array_distinct(F.flatten(F.array(fixed, *[F.col(f"_{s}") for s in SEARCHED])))
    targets = F.filter(targets, lambda t: (t != 0) & (t <= F.col(bound)))
    tried = rates.withColumn("_fixed", fixed).withColumn("throughput", F.explode(targets))

    # Stages held at one worker must reach the value as they are.
    tried = tried.filter(F.forall("_fixed", lambda r: (r == 0) | (r >= F.col("throughput"))))

    def workers(stage: str) -> Column:
        below = F.size(F.filter(F.col(f"_{stage}"), lambda r: r < F.col("throughput")))
        return F.when(F.col(stage) == 0, F.lit(1)).otherwise(below + 1)

    tried = tried.withColumns({f"{s}_par": workers(s) for s in SEARCHED})
    server = F.col("read_par") + F.col("deser_par") + F.col("comp_par") + 1
    client = F.col("decomp_par") + F.col("ser_par") + 1
    feasible = tried.filter((server <= F.col(server_cap)) & (client <= F.col(client_cap)))
    rank = F.struct(-F.col("throughput"), category_rank(F.col(codec), CODECS))
    chosen = F.struct(codec, "throughput", *[f"{s}_par" for s in SEARCHED])
    return feasible.groupBy(*keys).agg(F.min_by(chosen, rank).alias("_best")).select(*keys, "_best.*")


def allocate_workers(
    df: DataFrame,
    bound: str = "bound",
    server_cap: str = "server_cap",
    client_cap: str = "client_cap",
    stages: Sequence[str] = STAGES,
) -> DataFrame:
    """Add ``<stage>_par``: one more worker for the slowest stage, again and again.

    Stops when the slowest stage reaches the bound or either side is out of workers. Zero-rate
    stages keep one. Without a bound there is no plan: all columns are null. The steps are the (stage, workers) pairs sorted by rate, so the loop is a fold
    over one sorted array of the row.
    """

    def steps(i: int, stage: str) -> Column:
        cap = F.col(server_cap) if stage in SERVER_STAGES else F.col(client_cap)
        grown = F.transform(
            F.sequence(F.lit(1), F.greatest(cap, F.lit(1))),
            lambda w: F.struct(effective_rate(F.col(stage), w).alias("rate"), F.lit(i).alias("stage")),
        )
        return F.when(F.col(stage) > 0, grown).otherwise(F.slice(grown, 1, 0))

    ordered = F.array_sort(F.flatten(F.array(*[steps(i, s) for i, s in enumerate(stages)])))
    below = F.filter(ordered, lambda s: s["rate"] < F.col(bound))
    on_server = [i for i, s in enumerate(stages) if s in SERVER_STAGES]

    # Once a side is full nothing more is granted, so the steps given are a prefix of the sorted ones.
    def granted(acc: Column, step: Column) -> Column:
        server = step["stage"].isin(on_server)
        free = (acc["server"] < F.col(server_cap)) & (acc["client"] < F.col(client_cap))
        return F.when(
            free,
            F.struct(
                (acc["server"] + server.cast("int")).alias("server"),
                (acc["client"] + (~server).cast("int")).alias("client"),
                F.concat(acc["given"], F.array(step["stage"])).alias("given"),
            ),
        ).otherwise(acc)

    start = F.struct(
        F.lit(len(SERVER_STAGES)).alias("server"),
        F.lit(len(CLIENT_STAGES)).alias("client"),
        F.array().cast("array<int>").alias("given"),
    )
    given = F.aggregate("_steps", start, granted, lambda acc: acc["given"])
    allocated = df.withColumn("_steps", below).withColumn("_given", given)

    def count_of(i: int) -> Column:
        plan = F.lit(1) + F.size(F.filter("_given", lambda g: g == F.lit(i)))
        return F.when(F.col(bound).isNotNull(), plan)

    return allocated.withColumns({f"{s}_par": count_of(i) for i, s in enumerate(stages)}).drop("_steps", "_given")
