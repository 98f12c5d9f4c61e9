import itertools
import random

import pytest
from pyspark.sql import functions as F

from tableferry.fixed_values import CLIENT_STAGES, CODECS, SERVER_STAGES, STAGES
from tableferry.plans import rules, search


def rate(base, workers):
    return (0.3 + (1 - 0.3) * workers) * base


def every_combination(rows, server_cap, client_cap):
    """Loop over all settings: the first one with the highest throughput not above the bound."""
    best, best_throughput = None, 0
    for codec in CODECS:
        if codec not in rows:
            continue
        bound, base = rows[codec]
        for read, deser, comp in itertools.product(range(1, server_cap + 1), repeat=3):
            if read + deser + comp + 1 > server_cap:
                continue
            for decomp, ser in itertools.product(range(1, client_cap + 1), repeat=2):
                if decomp + ser + 1 > client_cap:
                    continue
                workers = dict(read=read, deser=deser, comp=comp, decomp=decomp, ser=ser)
                rates = [rate(base[s], workers.get(s, 1)) for s in STAGES]
                throughput = min((r for r in rates if r != 0), default=None)
                if throughput is not None and best_throughput < throughput <= bound:
                    best, best_throughput = (codec, throughput, read, deser, comp, decomp, ser), throughput
    return best


def greedy(base, bound, server_cap, client_cap):
    """One worker at a time to the slowest stage."""
    config = dict.fromkeys(STAGES, 1)
    rates = {s: b for s, b in base.items() if b > 0}
    server, client = 4, 4
    while rates and server < server_cap and client < client_cap:
        slowest = min(rates, key=lambda s: (rates[s], STAGES.index(s)))
        if rates[slowest] >= bound:
            break
        config[slowest] += 1
        rates[slowest] = rate(base[slowest], config[slowest])
        server += slowest in SERVER_STAGES
        client += slowest in CLIENT_STAGES
    return tuple(config[s] for s in STAGES)


def test_grid_search_equals_trying_everything(spark):
    rng = random.Random(5)
    rows, wanted = [], {}
    for key in range(25):
        server_cap, client_cap = rng.randrange(2, 8), rng.randrange(2, 7)
        per_codec = {}
        for codec in rng.sample(CODECS, rng.randrange(1, 4)):
            # few distinct values, so that ties and zero rates are common
            base = {s: float(rng.choice([0, 10, 20, 20, 40])) for s in STAGES}
            per_codec[codec] = (float(rng.choice([15, 34, 60, 1000])), base)
            rows.append((key, codec, per_codec[codec][0], server_cap, client_cap, *base.values()))
        wanted[key] = every_combination(per_codec, server_cap, client_cap)
    schema = "key int, compression string, bound double, server_cap int, client_cap int, " + ", ".join(
        f"{s} double" for s in STAGES
    )
    found = search.grid_search(spark.createDataFrame(rows, schema), ["key"]).collect()
    assert {r["key"]: tuple(r)[1:] for r in found} == {k: v for k, v in wanted.items() if v}


def test_allocation_equals_the_loop(spark):
    rng = random.Random(6)
    rows, wanted = [], []
    for key in range(300):
        base = {s: float(rng.choice([0, rng.randrange(1, 50), 20])) for s in STAGES}
        bound, server_cap, client_cap = float(rng.randrange(5, 400)), rng.randrange(2, 24), rng.randrange(2, 24)
        rows.append((key, bound, server_cap, client_cap, *base.values()))
        wanted.append(greedy(base, bound, server_cap, client_cap))
    schema = "key int, bound double, server_cap int, client_cap int, " + ", ".join(f"{s} double" for s in STAGES)
    found = search.allocate_workers(spark.createDataFrame(rows, schema)).orderBy("key").collect()
    assert [tuple(r[f"{s}_par"] for s in STAGES) for r in found] == wanted


@pytest.mark.parametrize(
    "read, write, network, codec, ratio, bound",
    [
        (1000.0, 5000.0, 0, "nocomp", 1.0, 1000.0),
        (1000.0, 5000.0, 125, "nocomp", 1.0, 125.0),
        (1000.0, 5000.0, 125, "zstd", 0.25, 500.0),
        (1000.0, 5000.0, 1000, "zstd", 0.25, 1000.0),  # equal: storage comes first
        (1000.0, 5000.0, 125, "zstd", 0.0, None),
        (None, 5000.0, 125, "nocomp", 1.0, None),
    ],
)
def test_bounds(spark, read, write, network, codec, ratio, bound):
    df = spark.createDataFrame(
        [(read, write, network, codec, ratio)], "r double, w double, n int, c string, q double"
    )
    got = df.select(rules.throughput_bound(F.col("r"), F.col("w"), F.col("n"), F.col("c"), F.col("q"))).first()[0]
    assert got == bound


@pytest.mark.parametrize(
    "source, target, codec, columnar, wanted",
    [
        # format, skip_ser, deser, ser, send, write
        ("csv", "csv", "nocomp", 1, (1, 1, 2, 6, 4, 8)),
        ("csv", "csv", "zstd", 1, (2, 1, 2, 6, 4, 8)),
        ("postgres", "pandas", "nocomp", 2, (2, 0, 3, 8, 1, 8)),
        ("postgres", "spark", "nocomp", 1, (1, 0, 3, 7, 4, 1)),
        ("postgres", "postgres", "zstd", 1, (1, 0, 3, 7, 4, 1)),
    ],
)
def test_layout_rules(spark, source, target, codec, columnar, wanted):
    df = spark.createDataFrame(
        [(source, target, codec, 1, columnar, 2, 3, 4, 5, 6, 7, 8)],
        "source_system string, target_system string, compression string, source_format int, target_format int, "
        "read_par int, deser_par int, send_par int, rcv_par int, decomp_par int, ser_par int, write_par int",
    )
    row = rules.layout_rules(df).first()
    assert tuple(row[c] for c in ("format", "skip_ser", "deser_par", "ser_par", "send_par", "write_par")) == wanted
