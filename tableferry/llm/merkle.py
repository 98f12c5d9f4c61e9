"""Merkle manifest of a dataset over a tree of hash midstates.

A leaf is the digest of one document's columns. Each group of documents (its ``source``) is a tree whose
leaves ascend by id and whose nodes take 16 children; the groups' roots are the leaves of one more tree.
A parent keeps, for each child slot, a copy of the hash's state before that slot, so folding a replaced
child resumes that state with the replacement and the siblings to its right only; what lies to the
left is never hashed again.

At scale: a step works on blocks of 4,096 consecutive nodes of one tree, which are three levels, and turns
each into one node of the next step; a group that holds a third of all documents is as many blocks
as it needs. The way back down hands each block the children on the path above it (16 digests a level),
and the last step folds all leaves of a block through the block's own midstates and then through the
states of the path, which are set up once for the block. Only digests are shuffled, and nothing but the
root comes to the driver. Every step's table is written, so lost executors repeat one step.

Defined results: a null column is ``-`` in the leaf; documents without a group are the first group and
documents without an id the first of their group; equal ids are ordered by their leaves, so equal rows
are leaves of their own; empty and long texts need nothing special; a table without rows has the
digest of nothing as its root and no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableferry.operators.ordering import with_position

from .stored import written

FANOUT = 16  # fixed value
LEVELS = 3  # levels that one step works on
BLOCK = FANOUT**LEVELS
HEX = 64  # characters of a digest
PATH = "array<struct<slot:int,kids:array<string>>>"
KEYS = ("tree", "block")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    """Digest of one document: each column's length in bytes and its value, ``-`` for null."""
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def levels_above(nodes: int) -> int:
    """Levels between so many nodes and the one above them all."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FANOUT), levels + 1
    return levels


class Midstates:
    """Nodes over a row of digests, with the hash states before every child slot."""

    def __init__(self, digests: list[str], levels: int) -> None:
        self.rows: list[bytes] = [b"".join(d.encode() for d in digests)]
        self.states: list[list] = []
        for _ in range(levels):
            below, states, above = self.rows[-1], [], []
            for at in range(0, len(below), FANOUT * HEX):
                state = sha256()
                for child in range(at, min(at + FANOUT * HEX, len(below)), HEX):
                    states.append(state.copy())
                    state.update(below[child : child + HEX])
                above.append(state.hexdigest().encode())
            self.states.append(states)
            self.rows.append(b"".join(above))

    def folded(self, slot: int, digest: bytes) -> bytes:
        """The top digest if the child at ``slot`` of the lowest row were ``digest``."""
        for states, row in zip(self.states, self.rows):
            state = states[slot].copy()
            state.update(digest)
            state.update(row[(slot + 1) * HEX : (slot // FANOUT + 1) * FANOUT * HEX])
            digest, slot = state.hexdigest().encode(), slot // FANOUT
        return digest

    def siblings(self, slot: int) -> list[bytes]:
        """The others of the run at each level, joined from left to right."""
        out = []
        for row in self.rows[: len(self.states)]:
            first = slot // FANOUT * FANOUT
            out.append(row[first * HEX : slot * HEX] + row[(slot + 1) * HEX : (first + FANOUT) * HEX])
            slot //= FANOUT
        return out

    def path(self, slot: int) -> list[dict]:
        out = []
        for row in self.rows[: len(self.states)]:
            first = slot // FANOUT * FANOUT
            run = row[first * HEX : (first + FANOUT) * HEX].decode()
            out.append({"slot": slot - first, "kids": [run[i : i + HEX] for i in range(0, len(run), HEX)]})
            slot //= FANOUT
        return out


class PathStates:
    """The parents on the way from one block to the root, each with its state before the block's slot."""

    def __init__(self, path: list[dict]) -> None:
        self.steps, others = [], []
        for level in path:
            kids, slot = [k.encode() for k in level["kids"]], level["slot"]
            left, right = b"".join(kids[:slot]), b"".join(kids[slot + 1 :])
            self.steps.append((sha256(left), right))
            others.append(left + right)
        self.siblings = b"".join(others)

    def folded(self, digest: bytes) -> bytes:
        for before, right in self.steps:
            state = before.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        return digest


def _tree(nodes: pa.Table) -> Midstates:
    """Midstates of one block, whose rows are sorted by position."""
    total = nodes.column("total")[0].as_py()
    return Midstates(nodes.column("digest").to_pylist(), min(LEVELS, levels_above(total)))


def _climb(nodes: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("pos")
    total = nodes.column("total")[0].as_py()
    top = _tree(nodes).rows[-1].decode()
    return pa.table({
        "tree": nodes.column("tree").slice(0, 1), "pos": nodes.column("block").slice(0, 1),
        "total": pa.array([-(-total // BLOCK)], pa.int64()), "digest": pa.array([top]),
    })


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))


def _steps(nodes: DataFrame, purpose: str) -> list[DataFrame]:
    """``nodes`` and, step by step, the nodes above them, until each tree is one node."""
    steps = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0  # one number
    while most > 1:
        above = _blocks(steps[-1]).select(*KEYS, "pos", "total", "digest").groupBy(*KEYS)
        steps.append(written(above.applyInArrow(_climb, "tree string, pos long, total long, digest string"), purpose))
        most = -(-most // BLOCK)
    return steps


def _path_type() -> pa.DataType:
    return pa.list_(pa.struct([("slot", pa.int32()), ("kids", pa.list_(pa.string()))]))


def _descend(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Each node's path to the root: through its block, then the block's own path."""
    nodes = nodes.sort_by("pos")
    tree, rest = _tree(nodes), above.column("path")[0].as_py()
    return pa.table({
        "tree": nodes.column("tree"), "pos": nodes.column("pos"),
        "path": pa.array([tree.path(i) + rest for i in range(len(nodes))], _path_type()),
    })


def _above(paths: DataFrame) -> DataFrame:
    return paths.select("tree", F.col("pos").alias("block"), "path")


def _paths(steps: list[DataFrame], top: DataFrame, purpose: str) -> DataFrame:
    """Paths of the first step's nodes, from those of the last step's."""
    paths = top
    for nodes in reversed(steps[:-1]):
        own = _blocks(nodes).select(*KEYS, "pos", "total", "digest").groupBy(*KEYS)
        pairs = own.cogroup(_above(paths).groupBy(*KEYS))
        paths = written(pairs.applyInArrow(_descend, f"tree string, pos long, path {PATH}"), purpose)
    return paths


@dataclass
class Manifest:
    """``leaves``: tree, pos, total, doc, digest and changed; ``steps``: the nodes of each step, leaves first;
    ``subroots``: tree, pos and digest of every group's root; ``root``: the dataset's digest."""

    leaves: DataFrame
    steps: list[DataFrame]
    subroots: DataFrame
    top_steps: list[DataFrame]
    root: str


def built(
    docs: DataFrame, columns: list[str], doc_col: str = "doc_id", group_col: str = "source",
    changed: Callable[[dict[str, Column]], tuple[Column, dict[str, Column]]] | None = None,
) -> Manifest:
    """The manifest of ``docs``. ``changed`` may give a condition and columns in place of others; where it holds,
    ``leaves.changed`` is the leaf of the altered document, to be folded later (else null)."""
    own = {c: docs[c] for c in columns}
    other = F.lit(None).cast("string")
    if changed is not None:
        where, instead = changed(own)
        other = F.when(where, leaf([instead.get(c, own[c]) for c in columns]))
    group = F.coalesce(F.concat(F.lit("="), docs[group_col].cast("string")), F.lit("-"))  # null before all names
    rows = docs.select(
        group.alias("tree"), docs[doc_col].cast("long").alias("doc"), leaf(list(own.values())).alias("digest"),
        other.alias("changed"),
    )
    placed = with_position(rows, ["tree", "doc", "digest"], "pos")
    trees = placed.groupBy("tree").agg(F.min("pos").alias("first"), F.count("*").alias("total"))
    leaves = written(
        placed.join(trees, "tree").select("tree", (F.col("pos") - F.col("first")).alias("pos"), "total", "doc", "digest", "changed"),
        "merkle-leaves",
    )
    steps = _steps(leaves, "merkle-nodes")
    roots = with_position(steps[-1].select(F.col("tree").alias("name"), "digest"), ["name"], "pos")
    several = roots.agg(F.count("*").alias("total"))
    total = several.first()["total"]  # one number: groups
    subroots = written(roots.select(F.lit("").alias("tree"), "pos", F.lit(total).alias("total"), "digest", "name"), "merkle-subroots")
    top = _steps(subroots, "merkle-top")
    found = top[-1].select("digest").first()
    return Manifest(leaves, steps, subroots.select(F.col("name").alias("tree"), "pos", "digest"), top,
                    found["digest"] if found else sha256(b"").hexdigest())


def _last_step(root: str, with_proof: bool):
    names = ["doc", "leaf", "subroot", "proof_sha256", "folded_root"] + (["proof"] if with_proof else [])

    def run(leaves: pa.Table, above: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("pos")
        tree, way = _tree(leaves), PathStates(above.column("path")[0].as_py())
        proofs, folded, spelled = [], [], []
        for slot, (own, other) in enumerate(zip(leaves.column("digest").to_pylist(), leaves.column("changed").to_pylist())):
            siblings = b"".join(tree.siblings(slot)) + way.siblings
            proofs.append(sha256(siblings).hexdigest())
            folded.append(way.folded(tree.folded(slot, (other or own).encode())).decode())
            if with_proof:
                spelled.append([siblings[i : i + HEX].decode() for i in range(0, len(siblings), HEX)])
        n = len(leaves)
        out = [
            leaves.column("doc"), leaves.column("digest"), pa.array([above.column("subroot")[0].as_py()] * n, pa.string()),
            pa.array(proofs, pa.string()), pa.array(folded, pa.string()),
        ]
        return pa.table(out + ([pa.array(spelled, pa.list_(pa.string()))] if with_proof else []), names=names)

    schema = "doc long, leaf string, subroot string, proof_sha256 string, folded_root string"
    return run, schema + (", proof array<string>" if with_proof else "")


def verified(manifest: Manifest, with_proof: bool = False) -> DataFrame:
    """One row per document: its leaf, subroot and root, the digest of its proof (and the proof), the root folded
    from its changed leaf, or its own where nothing changed, and whether that is the root."""
    names = manifest.top_steps[0].select(F.col("pos").alias("at"), F.col("name").alias("group"))
    start = manifest.top_steps[-1].select("tree", "pos", F.expr(f"cast(array() as {PATH})").alias("path"))
    of_groups = _paths(manifest.top_steps, start, "merkle-top-paths").join(names, F.col("pos") == F.col("at")).select(
        F.col("group").alias("tree"), F.lit(0).cast("long").alias("pos"), "path"
    )
    above = _above(_paths(manifest.steps[1:], written(of_groups, "merkle-group-paths"), "merkle-paths"))
    above = above.join(manifest.subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    run, schema = _last_step(manifest.root, with_proof)
    found = _blocks(manifest.leaves).groupBy(*KEYS).cogroup(above.groupBy(*KEYS)).applyInArrow(run, schema)
    return found.select(
        "doc", "leaf", "subroot", F.lit(manifest.root).alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(manifest.root)).alias("verified"), *(["proof"] if with_proof else []),
    )
