"""Near-duplicate documents by SetSketch registers, with links confirmed on full sets.

1. Every document becomes the set of its word shingles (64-bit hashes) and a sketch: register i
   holds the exponentially spaced, truncated minimum of an exponential hash over the set
   (``K = 1 + floor(-log_b(min))``). Sketches merge by the register-wise maximum.
2. Documents with equal sets are one class; only its smallest id goes on.
3. Bands of registers are hashed; equal bands make a bucket. In a bucket nobody is compared with
   everybody: each member is compared with one pivot, the member that shares its bands with most.
4. Pairs that meet in buckets of two are first judged by the likelihood of their registers (joint
   estimate of the similarity, set sizes known) and dropped far below the threshold.
5. The remaining pairs are confirmed on full sets. Clusters that fall apart leave a residue, and it is
   worked through completely. Take the centre C of a cluster (shingles that most members have). If x
   is not as similar to C as the threshold asks, x can be linked with y only if x and y share a
   difference from C, a shingle that C lacks or one that C has. (Were the differences dx, dy disjoint,
   |x ^ y| = |dx| + |dy| would be too large already by dx.) So members far from C are joined with the
   others on the rarest of their differences, as many as a linked pair can lack and one, and the place
   of a shared one tells how many more can be shared. Members near C are compared with a few hubs, those
   with the fewest differences for their size; what can be linked without shared differences is connected then.
   The rare ones that stay unconnected are joined with the others near C as above. Connected members
   are never compared again.
6. Links are closed to components by alternating large-star and small-star rounds.

Nothing is collected: sketches, pairs, links and components are written tables. Texts are shuffled
only for members of pairs.

Defined results: null and empty texts have an empty set and are linked with nothing; a text shorter
than a shingle is one shingle; rows with the same id count as one document with several texts; a row
without an id is linked with nothing and kept; of equal documents the smallest id stays; empty tables
give empty results; other columns are passed on untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import text_batches
from .stored import sent_if_small, written
from .text import fresh

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
BASE = 1.02  # spacing of the register values
RATE = 20.0  # of the exponential hashes
TOP = (1 << 16) - 2
HUBS = 16  # members nearest to a cluster's centre that others are compared with
SALTS = 64  # parts of a cluster whose hubs are found apart
MARGIN = 5  # standard errors that an estimate may lie below the threshold


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words, A-Z lower-cased."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = max(1, len(words) - size + 1)
    mixed = np.full(n, min(size, len(words)), np.uint64)
    for k in range(min(size, len(words))):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(members: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    factors = _multipliers()
    for at in range(0, len(members), 256):
        np.minimum(least, (members[at : at + 256, None] * factors).min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 1) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    return np.clip(1 + np.floor(-np.log(exponential) / math.log(BASE)), 0, TOP).astype(np.uint16)


def estimate(above: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of largest likelihood, from how many registers of the first are above and below the second's.

    Known set sizes n and m; p(x) = -log_b(1 - x (b - 1) / b) is the chance that a register of one
    set is above the other's, for x = u - v J with u = n / (n + m).
    """
    u = n / (n + m)
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)[:, None]

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

    up, down = chance(u[:, None] - v[:, None] * grid), chance(v[:, None] - u[:, None] * grid)
    same = np.clip(1 - up - down, 1e-12, 1)
    a, b = above[:, None], below[:, None]
    like = a * np.log(up) + b * np.log(down) + (REGISTERS - a - b) * np.log(same)
    return np.take_along_axis(grid, like.argmax(axis=1)[:, None], axis=1)[:, 0]


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, digests, registers, bands = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                members = shingles(text, size)
                ns.append(len(members))
                if not len(members):
                    digests.append(None), registers.append(None), bands.append([])
                    continue
                k = sketch(members)
                digests.append(xxhash.xxh3_128_digest(members.tobytes()))
                registers.append(k.tobytes())
                bands.append(
                    [
                        xxhash.xxh3_64_intdigest(k[ROWS * j : ROWS * j + ROWS].tobytes(), seed=j) - (1 << 63)
                        for j in range(BANDS)
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"), batch.column("text_key"), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()),
                    pa.array(registers, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc", "text_key", "n", "digest", "registers", "bands"],
            )

    return run


def sketched(docs: DataFrame, doc_col: str, text_col: str, size: int) -> DataFrame:
    """``doc, text_key, n, digest, registers, bands`` of every row."""
    kind = docs.schema[doc_col].dataType.simpleString()
    own = docs.select(docs[doc_col].alias("doc"), F.xxhash64(docs[text_col]).alias("text_key"), docs[text_col].alias("text"))
    return own.mapInArrow(
        _sketches(size), f"doc {kind}, text_key long, n long, digest binary, registers binary, bands array<long>"
    )


def _pairs(nodes: DataFrame) -> DataFrame:
    """Distinct (pivot, member) pairs of all buckets; ``alone`` if they met in buckets of two only."""
    members = nodes.select("doc", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = written(members.join(sizes, "bucket"), "buckets")
    scores = shared.groupBy("doc").agg(F.sum("size").alias("score"))
    scored = shared.join(scores, "doc")
    pivots = scored.groupBy("bucket").agg(F.max_by("doc", F.struct("score", "doc")).alias("pivot"))
    return (
        shared.join(pivots, "bucket")
        .filter(F.col("doc") != F.col("pivot"))
        .groupBy("pivot", F.col("doc").alias("member"))
        .agg((F.max("size") == 2).alias("alone"))
    )


def _hopeful(similarity: float):
    """Pairs of buckets of two whose estimate is not far below the threshold; all others as they are."""
    floor = similarity - MARGIN * math.sqrt(similarity * (1 - similarity) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS).astype(np.int32)
                for c in ("pivot_registers", "member_registers")
            )
            n, m = (batch.column(c).to_numpy().astype(np.float64) for c in ("pivot_n", "member_n"))
            found = estimate((x > y).sum(axis=1), (x < y).sum(axis=1), n, m)
            stays = pa.array(~batch.column("alone").to_numpy(zero_copy_only=False) | (found >= floor))
            out = batch.select(["pivot", "member", "alone"]).filter(stays)
            if out.num_rows:
                yield out

    return run


def _estimated(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    def own(side: str) -> DataFrame:
        return nodes.select(F.col("doc").alias(side), F.col("n").alias(f"{side}_n"), F.col("registers").alias(f"{side}_registers"))

    joined = pairs.join(own("member"), "member").join(own("pivot"), "pivot")
    # exact: a set smaller than the threshold's share of the other can not be linked
    possible = ~F.col("alone") | (F.least("pivot_n", "member_n") >= similarity * F.greatest("pivot_n", "member_n") - 1e-9)
    return joined.filter(possible).mapInArrow(_hopeful(similarity), pairs.select("pivot", "member", "alone").schema)


def _confirm(size: int, percent: int):
    """Exact link of each pair, and how the member differs from the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            linked, sizes, added, lacked = [], [], [], []
            rows = zip(
                batch.column("pivot_text").cast(pa.binary()).to_pylist(),
                batch.column("member_text").cast(pa.binary()).to_pylist(),
                batch.column("alone").to_pylist(),
            )
            for pivot_text, member_text, alone in rows:
                if pivot_text != last[0]:
                    last = (pivot_text, shingles(pivot_text, size))
                pivot, member = last[1], shingles(member_text, size)
                both = len(np.intersect1d(pivot, member, assume_unique=True))
                link = 100 * both >= percent * (len(pivot) + len(member) - both)
                linked.append(link)
                sizes.append((len(pivot), len(member)))
                if alone:
                    added.append(None), lacked.append(None)
                else:
                    added.append(np.setdiff1d(member, pivot, assume_unique=True).view(np.int64))
                    lacked.append(np.setdiff1d(pivot, member, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("pivot"), batch.column("member"), pa.array(linked, pa.bool_()),
                    pa.array([s[0] for s in sizes], pa.int64()), pa.array([s[1] for s in sizes], pa.int64()),
                    pa.array(added, pa.list_(pa.int64())), pa.array(lacked, pa.list_(pa.int64())),
                ],
                ["pivot", "member", "linked", "pivot_n", "member_n", "added", "lacked"],
            )

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``pairs`` (pivot, member, alone) with ``linked`` and the differences; texts are ``doc, text``."""
    needed = written(
        pairs.select(F.explode(F.array("pivot", "member")).alias("doc")).distinct(), "texts-of-pairs"
    )
    own = texts.join(sent_if_small(needed), "doc", "left_semi")
    joined = pairs.join(own.select(F.col("doc").alias("member"), F.col("text").alias("member_text")), "member").join(
        own.select(F.col("doc").alias("pivot"), F.col("text").alias("pivot_text")), "pivot"
    )
    kind = pairs.schema["pivot"].dataType.simpleString()
    return joined.select("pivot", "member", "alone", "pivot_text", "member_text").mapInArrow(
        _confirm(size, percent),
        f"pivot {kind}, member {kind}, linked boolean, pivot_n long, member_n long, added array<long>, lacked array<long>",
    )


def _slack(percent: int) -> float:
    """Differences that two linked sets may have at most, as a share of the sum of their sizes."""
    return (100 - percent) / (100 + percent)


def _centred(compared: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Members of the clusters that fell apart, described by how they differ from the cluster's centre.

    A cluster is a pivot and all that were compared with it. Its centre is the set of the shingles that
    more than half of its members have; it need not be a document. ``excess``: differences beyond those that
    the own shingles allow for a link. ``near``: so similar to the centre as linked documents are to each other.
    """
    rows = compared.filter(F.col("added").isNotNull()).select(
        F.col("pivot").alias("b"), "member", F.col("pivot_n").alias("b_n"), F.col("member_n").alias("n"), "added", "lacked"
    )
    none = F.array().cast("array<long>")
    pivots = rows.groupBy("b").agg(F.first("b_n").alias("b_n")).select(
        "b", F.col("b").alias("member"), "b_n", F.col("b_n").alias("n"), none.alias("added"), none.alias("lacked")
    )
    part = parts.select(F.col("doc").alias("member"), "part")
    rows = rows.unionByName(pivots).join(part, "member", "left").withColumn("part", F.coalesce("part", "member"))
    apart = rows.groupBy("b").agg(F.count("*").alias("size"), F.min("part").alias("low"), F.max("part").alias("high"))
    rows = written(rows.join(apart.filter(F.col("low") != F.col("high")).select("b", "size"), "b"), "fallen-apart")
    often = (
        rows.select("b", "size", F.explode(F.array(F.struct(F.lit(True).alias("more"), F.col("added").alias("of")), F.struct(F.lit(False).alias("more"), F.col("lacked").alias("of")))).alias("x"))
        .select("b", "size", "x.more", F.explode("x.of").alias("f"))
        .groupBy("b", "more", "f")
        .agg(F.count("*").alias("n"), F.first("size").alias("size"))
        .filter(2 * F.col("n") > F.col("size"))
        .groupBy("b")  # a centre is no larger than the mean set of its cluster allows: twice its mean at most
        .agg(F.collect_list(F.when(F.col("more"), F.col("f"))).alias("plus"), F.collect_list(F.when(~F.col("more"), F.col("f"))).alias("minus"))
    )
    rows = rows.join(often, "b", "left").withColumns({"plus": F.coalesce("plus", none), "minus": F.coalesce("minus", none)})
    slack = _slack(percent)
    centred = rows.select(
        "b", "member", "part", "n", (F.col("b_n") + F.size("plus") - F.size("minus")).alias("centre_n"),
        F.array_union(F.array_except("added", "plus"), F.array_except("minus", "lacked")).alias("added"),
        F.array_union(F.array_except("lacked", "minus"), F.array_except("plus", "added")).alias("lacked"),
    )
    excess = F.size("added") + F.size("lacked") - slack * F.col("n")
    return centred.withColumns({"excess": excess, "near": excess <= slack * F.col("centre_n") + 1e-6})


def _near_hubs(near: DataFrame, percent: int) -> DataFrame:
    """Pairs of unconnected members near a centre, one of them a hub.

    The first hub has the smallest excess of all, so it is linked with every member whose excess does not
    outweigh the own one of any other: links that need no shared difference need no other pair.
    """
    hubs = near.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)))
    for keys in (["b", "salt"], ["b"]):  # first of each part of a cluster, then of the parts' firsts
        order = Window.partitionBy(*keys).orderBy("excess", "member")
        hubs = hubs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= HUBS).drop("place")

    def side(name: str, own: DataFrame) -> DataFrame:
        return own.select(F.col("b").alias(f"{name}_b"), F.col("member").alias(name), F.col("part").alias(f"{name}_part"),
                          F.col("n").alias(f"{name}_n"), F.size("added").alias(f"{name}_a"),
                          F.size("lacked").alias(f"{name}_d"), F.col("excess").alias(f"{name}_excess"))

    room = F.least("x_d", "y_d") + F.least("x_a", "y_a")
    meet = (F.col("x_b") == F.col("y_b")) & (F.col("x_part") != F.col("y_part"))
    meet = meet & (room >= (F.col("x_excess") + F.col("y_excess")) / 2 - 1e-6)
    meet = meet & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
    met = side("x", near).join(side("y", hubs), meet)
    return met.select(F.least("x", "y").alias("pivot"), F.greatest("x", "y").alias("member")).distinct()


def _rare_first(rows: DataFrame) -> DataFrame:
    """Every difference that members of a cluster share, with its ``place`` among the member's own, the rarest first."""
    kinds = [F.struct(F.lit(more).alias("more"), F.col(of).alias("of")) for more, of in ((True, "added"), (False, "lacked"))]
    each = rows.select("b", "member", F.explode(F.array(*kinds)).alias("x")).select("b", "member", "x.more", F.explode("x.of").alias("f"))
    often = each.groupBy("b", "more", "f").agg(F.count("*").alias("k")).filter("k > 1")
    shared = each.join(often, ["b", "more", "f"]).groupBy("b", "member", "more").agg(
        F.array_sort(F.collect_list(F.struct("k", "f"))).alias("shared")
    )
    own = rows.select("b", "member", "part", "n", "centre_n", "excess", "first", F.size("added").alias("a"), F.size("lacked").alias("d"))
    own = own.join(shared, ["b", "member"]).withColumn("all", F.when(F.col("more"), F.col("a")).otherwise(F.col("d")))
    return own.select("*", F.posexplode("shared").alias("at", "s")).select(
        *[c for c in own.columns if c not in ("a", "shared")], F.col("s.f").alias("f"),
        (F.col("all") - F.size("shared") + F.col("at") + 1).alias("place"),  # those of nobody else come first
    )


def _sharing(rows: DataFrame, percent: int, far: bool) -> DataFrame:
    """Pairs of unconnected members of a cluster, one of them marked ``first``, whose shared differences may suffice for a link.

    Linked members share half the sum of their excesses at least. All differences have one order, the
    rarest first, so the first one that a pair shares tells how many can follow, and lies early in both:
    of n shingles a linked set lacks no more than the threshold allows, and its additions come before
    the centre's shingles. If no addition is shared, lacks alone must suffice, also against the smallest
    excess the other can have: that of the centre, or, if all that are marked are ``far``, its opposite.
    """
    ranked = written(_rare_first(rows), "rare-first")
    least = -_slack(percent) * F.col("centre_n")

    def side(name: str, own: DataFrame, other) -> DataFrame:
        lacks = F.greatest(F.ceil((F.col("excess") + other) / 2 - 1e-6), F.lit(1))
        early = F.when(F.col("more"), F.floor(F.col("n") * (100 - percent) / 100) + 1).otherwise(F.col("all") - lacks + 1)
        own = own.filter(F.col("place") <= early).drop("centre_n")
        return own.select(*[F.col(c).alias(f"{name}_{c}") for c in own.columns])

    later = F.least(F.col("x_all") - F.col("x_place"), F.col("y_all") - F.col("y_place"))
    lacks = F.when(F.col("x_more"), F.least("x_d", "y_d")).otherwise(0)
    meet = (F.col("x_b") == F.col("y_b")) & (F.col("x_more") == F.col("y_more")) & (F.col("x_f") == F.col("y_f"))
    meet = meet & (F.col("x_part") != F.col("y_part")) & (~F.col("y_first") | (F.col("x_member") < F.col("y_member")))
    meet = meet & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
    meet = meet & (later + 1 + lacks >= (F.col("x_excess") + F.col("y_excess")) / 2 - 1e-6)
    met = side("x", ranked.filter("first"), least).join(side("y", ranked, -least if far else least), meet)
    return met.select(F.least("x_member", "y_member").alias("pivot"), F.greatest("x_member", "y_member").alias("member")).distinct()


def _residual_pairs(centred: DataFrame, percent: int) -> DataFrame:
    """First what shares differences with a member far from the centre, and near members with the hubs."""
    pairs = _sharing(centred.withColumn("first", ~F.col("near")), percent, far=True)
    return pairs.unionByName(_near_hubs(centred.filter("near"), percent)).distinct()


def _stray_pairs(centred: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Then near members that not even the hubs have connected, with near members they share differences with."""
    part = parts.select(F.col("doc").alias("member"), F.col("part").alias("now"))
    near = centred.filter("near").join(part, "member", "left").withColumn("part", F.coalesce("now", "member")).drop("now")
    sizes = near.groupBy("b", "part").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("b").agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.count("*").alias("pieces"))
    split = near.join(largest.filter("pieces > 1").select("b", "main"), "b").withColumn("first", F.col("part") != F.col("main"))
    return _sharing(split, percent, far=False)


def _stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` only, and no ``v`` is a ``u``."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("u").agg(F.sum("up").alias("ups"), F.max("down").alias("down"))
    return seen.filter("ups > 1 or ups + down > 1").isEmpty()


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """``doc, part`` (smallest reachable id) of every end of the links (``a``, ``b``).

    Alternates large-star and small-star until only stars are left; each round is two small
    aggregates and joins, written to the shared folder.
    """
    edges = written(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        purpose,
    )
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        # large star: neighbours above a node go to its smallest neighbour
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = written(large.filter(F.col("u") != F.col("v")).distinct(), purpose)
        # small star: a node and its neighbours below go to the smallest of them
        lower = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct(), purpose)
    roots = edges.select(F.col("v").alias("doc")).distinct().withColumn("part", F.col("doc"))
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("part")).unionByName(roots)


def grouped(
    docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """``doc, text_key, n, part`` of every row: set size and smallest id of the component (null without an id)."""
    text_batches(docs.sparkSession)
    percent = round(100 * similarity)
    rows = written(sketched(docs, doc_col, text_col, size), "sketches")
    full = rows.filter(F.col("n") > 0).filter(F.col("doc").isNotNull())
    classes = full.groupBy("digest").agg(F.min("doc").alias("node"))
    whole = full.select("doc", "digest", "n", "registers", "bands")
    nodes = written(
        whole.join(classes, "digest").filter(F.col("doc") == F.col("node")).dropDuplicates(["digest"])
        .select("doc", "n", "registers", "bands"),
        "nodes",
    )
    texts = docs.select(docs[doc_col].alias("doc"), docs[text_col].alias("text"))
    pairs = written(_estimated(_pairs(nodes), nodes, similarity), "pairs")
    compared = written(confirmed(pairs, texts, size, percent), "compared")
    same = full.select("doc", "digest").join(classes, "digest").select(F.col("doc").alias("a"), F.col("node").alias("b"))
    links = compared.filter("linked").select(F.col("pivot").alias("a"), F.col("member").alias("b"))
    parts = written(components(links), "parts")
    centred = written(_centred(compared, parts, percent), "centred")
    links = [links]
    for last in (False, True):
        residue = _stray_pairs(centred, parts, percent) if last else _residual_pairs(centred, percent)
        residue = written(residue.withColumn("alone", F.lit(True)), "residue")
        more = written(confirmed(residue, texts, size, percent).filter("linked").select("pivot", "member"), "residual-links")
        if more.isEmpty():
            continue
        links.append(more.select(F.col("pivot").alias("a"), F.col("member").alias("b")))
        parts = written(components(reduce(DataFrame.unionByName, links)), "parts")
    node_of = same.distinct()
    final = node_of.join(parts.withColumnRenamed("doc", "b"), "b", "left").select(
        F.col("a").alias("doc"), F.coalesce("part", "b").alias("part")
    )
    by_doc = final.groupBy("doc").agg(F.min("part").alias("part"))
    return rows.select("doc", "text_key", "n").join(by_doc, "doc", "left").withColumn("part", F.coalesce("part", "doc"))


def first_of_each_group(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows of ``docs`` that are the smallest id of their group (or have no id), columns unchanged."""
    dropped = grouped(docs, doc_col, text_col, **how).filter(F.col("part") != F.col("doc")).select("doc").distinct()
    gone = fresh(docs, "_gone")
    table = sent_if_small(written(dropped.withColumnRenamed("doc", gone), "dropped"))
    return docs.join(table, docs[doc_col] == table[gone], "left_anti")
