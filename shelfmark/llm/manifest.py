"""Merkle manifest of a table: one root, and for every row the path of digests that proves it.

Rows are leaves of one tree for each group, ordered by a key; every ``FAN`` consecutive
nodes become the digest of their texts until one is left, the subroot. Subroots, ordered
by group, are the leaves of the last tree, which gives the root.

A tree is cut into aligned blocks of ``height`` levels (4,096 leaves). A block is one row:
its digests in van Emde Boas order, that is the upper half of its levels first, then each
subtree below them, both laid out alike. ``address`` computes a node's slot from its level
and number, so construction and sibling look-up touch few cache lines at any cache size.
Block roots are the leaves of the next round, until each tree is one block: three rounds
cover 6.9e10 rows. Paths go down again round by round, one short text a block.

Positions come from a range sort over (group, key, digest, arrival), so a group with most
of the rows, or many equal rows, is spread over tasks; no group is ever in one task.

Null values count as ``-``; a null group is a group, the first. Rows of equal key are
ordered by digest; equal rows have equal leaves and proofs of different places. Texts of
any length are digested where they are read and not moved. Empty tables give empty
results. Columns that are not asked for, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.tables import materialise

# Fixed value: nodes that become one digest.
FAN = 16
#: Levels of a block.
HEIGHT = 3
DIGEST = 32
_PART = 33  # bits of monotonically_increasing_id below the partition


def leaf_text(*values: Column) -> Column:
    """Values one after the other, each as its UTF-8 byte count, a colon and itself, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(leaf_text(*values), 256)


# --- blocks ---------------------------------------------------------------------------


def nodes_in(levels: int) -> int:
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Slots of the nodes ``number`` at ``depth`` (0: the root) of a complete tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(number)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, number)
    span = FAN ** (depth - upper)
    return nodes_in(upper) + number // span * nodes_in(levels - upper) + address(levels - upper, depth - upper, number % span)


@cache
def _slots(levels: int, depth: int) -> np.ndarray:
    return address(levels, depth, np.arange(FAN**depth))


def _height(leaves: int) -> int:
    """Levels above the leaves of a tree that ends in one node."""
    height = 0
    while FAN**height < leaves:
        height += 1
    return height


def _hash(texts: bytes) -> bytes:
    return hashlib.sha256(texts).digest()


def build_block(leaves: list[bytes], height: int) -> bytes:
    """The digests of a block in van Emde Boas order; slots without a node are zero."""
    nodes = np.zeros((nodes_in(height + 1), DIGEST), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        nodes[_slots(height + 1, depth)[: len(level)]] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, DIGEST)
        if depth:
            level = [_hash("".join(d.hex() for d in level[i : i + FAN]).encode()) for i in range(0, len(level), FAN)]
    return nodes.tobytes()


class Block:
    """A stored block: its digests by level, and the siblings of any node."""

    def __init__(self, nodes: bytes, leaves: int, height: int):
        self.height = height
        table = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
        self.levels: list[list[bytes]] = []  # hex texts, the leaves first
        for depth in range(height, -1, -1):
            self.levels.append([table[s].tobytes().hex().encode() for s in _slots(height + 1, depth)[:leaves]])
            leaves = -(-leaves // FAN)

    def around(self, level: int, number: int) -> tuple[bytes, bytes]:
        """Siblings left and right of a node."""
        first = number - number % FAN
        run = self.levels[level]
        return b"".join(run[first:number]), b"".join(run[number + 1 : first + FAN])

    def path(self, number: int, start: int = 0) -> list[tuple[bytes, bytes]]:
        """Siblings from a node of level ``start`` to the block's root."""
        return [self.around(level, number // FAN ** (level - start)) for level in range(start, self.height)]


# --- positions ------------------------------------------------------------------------


def positioned(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, key, digest, ...) with each row's position in its tree and the tree's total."""
    ranged = rows.withColumn("_arrival", F.monotonically_increasing_id())
    order = ["tree", "key", "digest", "_arrival"]
    stored = materialise(ranged.repartitionByRange(*order).sortWithinPartitions(*order).drop("_arrival").withColumn("_mark", F.monotonically_increasing_id()))
    part = F.shiftright("_mark", _PART)
    pieces = stored.groupBy("tree", part.alias("_part")).agg(F.min("_mark").alias("_first"), F.count("*").alias("_n"))
    by_tree = Window.partitionBy("tree")
    before = F.sum("_n").over(by_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialise(pieces.select("tree", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(by_tree).alias("total")))
    found = stored.withColumn("_part", part).join(offsets, ["tree", "_part"])
    return found.withColumn("position", F.col("_mark") - F.col("_first") + F.col("_before")).drop("_part", "_mark", "_first", "_before", "key")


# --- construction ---------------------------------------------------------------------


@dataclass
class Forest:
    """Blocks of each round: (tree, block, leaves, height, total, nodes, digest, kept lists)."""

    rounds: list[DataFrame]
    height: int

    def ends(self, turn: int) -> DataFrame:
        """Blocks of a round that are the top of their tree; their digest is the tree's root."""
        return self.rounds[turn].where(F.col("total") <= FAN**self.height)

    def roots(self) -> DataFrame:
        found = self.ends(0)
        for turn in range(1, len(self.rounds)):
            found = found.select("tree", "digest").unionByName(self.ends(turn).select("tree", "digest"))
        return found.select("tree", "digest")


def _blocks(level: DataFrame, height: int, kept: list[str]) -> DataFrame:
    """One row for each block; ``kept`` columns travel as lists in the order of the leaves."""
    fields = "".join(f", {c} array<{level.schema[c].dataType.simpleString()}>" for c in kept)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("position")
        total, n = group.column("total")[0].as_py(), len(group)
        own = _height(total) if total <= FAN**height else height
        nodes = build_block([bytes.fromhex(d) for d in group.column("digest").to_pylist()], own)
        columns = {
            "tree": group.column("tree")[:1], "block": group.column("block")[:1], "leaves": pa.array([n], pa.int32()), "height": pa.array([own], pa.int32()),
            "total": pa.array([total], pa.int64()), "nodes": pa.array([nodes]), "digest": pa.array([nodes[:DIGEST].hex()]),
        }
        for c in kept:
            columns[c] = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), group.column(c).combine_chunks())
        return pa.table(columns)

    keyed = level.withColumn("block", F.floor(F.col("position") / FAN**height).cast("long"))
    schema = f"tree string, block long, leaves int, height int, total long, nodes binary, digest string{fields}"
    return keyed.groupBy("tree", "block").applyInArrow(run, schema)


def build(level: DataFrame, kept: list[str], height: int = HEIGHT) -> Forest:
    """Blocks over (tree, position, total, digest, kept columns), round by round until every tree has one root."""
    forest, span = Forest([], height), FAN**height
    while True:
        forest.rounds.append(materialise(_blocks(level, height, kept)))
        level = forest.rounds[-1].where(F.col("total") > span).select(
            "tree", F.col("block").alias("position"), F.ceil(F.col("total") / span).cast("long").alias("total"), "digest")
        kept = []
        if level.isEmpty():
            return forest


@dataclass
class Manifest:
    """The trees of the groups, and the tree over their roots (kept column ``child``: the group's tree)."""

    groups: Forest
    top: Forest


def merkle_manifest(rows: DataFrame, kept: list[str], height: int = HEIGHT) -> Manifest:
    """Manifest of (tree, key, digest, kept columns); trees are ordered by name."""
    groups = build(positioned(rows.select("tree", "key", "digest", *kept)), kept, height)
    subroots = groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.col("tree").alias("child"))
    return Manifest(groups, build(positioned(subroots), ["child"], height))


# --- proofs ---------------------------------------------------------------------------

STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
STEPS = "array<struct<left:string,right:string>>"


def _steps(path: list[tuple[bytes, bytes]]) -> list[dict[str, str]]:
    return [{"left": a.decode(), "right": b.decode()} for a, b in path]


def _paths_down(blocks: DataFrame, child: str | None = None) -> DataFrame:
    """(tree, block, above) for each leaf of the blocks: the siblings above it.

    A leaf is a block of the round below, or, where ``child`` lists their names, a tree.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["nodes"], row["leaves"], row["height"])
                numbers = range(row["leaves"])
                first = row["block"] * FAN ** row["height"]
                yield pa.record_batch([
                    pa.array(row[child] if child else [row["tree"]] * len(numbers), pa.string()),
                    pa.array([0 if child else first + i for i in numbers], pa.int64()),
                    pa.array([_steps(block.path(i)) + row["above"] for i in numbers], pa.list_(STEP)),
                ], names=["tree", "block", "above"])

    wanted = ["tree", "block", "leaves", "height", "nodes", "above", *([child] if child else [])]
    return blocks.select(wanted).mapInArrow(run, f"tree string, block long, above {STEPS}")


def with_paths(forest: Forest, above: DataFrame) -> DataFrame:
    """The first round's blocks with ``above``: the siblings that follow a block's root.

    The given ``above`` (tree, above) is what follows each tree's own root.
    """
    known = None
    for turn in range(len(forest.rounds) - 1, -1, -1):
        blocks = forest.ends(turn).join(above, "tree")
        if known is not None:
            blocks = blocks.unionByName(forest.rounds[turn].where(F.col("total") > FAN**forest.height).join(known, ["tree", "block"]))
        if turn:
            known = materialise(_paths_down(blocks))
    return blocks


def proofs(manifest: Manifest, key: str, changed: str) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root) of every row.

    ``changed`` is the kept column with a digest to fold in place of the leaf's, or null.
    """
    empty = F.array().cast(STEPS)
    tops = with_paths(manifest.top, manifest.top.roots().select("tree", empty.alias("above")))
    above = materialise(_paths_down(tops, "child").drop("block"))
    blocks = with_paths(manifest.groups, above)
    subroots = materialise(manifest.groups.roots().withColumnRenamed("digest", "subroot"))
    root = next((r["digest"] for r in manifest.top.roots().collect()), None)  # one row, none for an empty table

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = row["leaves"]
                block = Block(row["nodes"], n, row["height"])
                after = [(s["left"].encode(), s["right"].encode()) for s in row["above"]]
                leaves, proof, folded = block.levels[0], [], []
                for first in range(0, n, FAN):
                    upper = block.path(first // FAN, 1) + after if row["height"] else after
                    rest = b"".join(a + b for a, b in upper)
                    for i in range(first, min(first + FAN, n)):
                        left, right = block.around(0, i) if row["height"] else (b"", b"")
                        proof.append(hashlib.sha256(left + right + rest).hexdigest())
                        node = (row["changed"][i] or "").encode() or leaves[i]
                        for a, b in [(left, right), *upper] if row["height"] else upper:
                            node = hashlib.sha256(a + node + b).hexdigest().encode()
                        folded.append(node.decode())
                yield pa.record_batch([
                    pa.array(row["keys"], batch.schema.field("keys").type.value_type), pa.array([x.decode() for x in leaves]),
                    pa.array([row["subroot"]] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(proof), pa.array(folded),
                ], names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    kind = manifest.groups.rounds[0].schema[key].dataType.elementType.simpleString()
    found = blocks.select("tree", "leaves", "height", "nodes", "above", F.col(key).alias("keys"), F.col(changed).alias("changed")).join(subroots, "tree")
    return found.mapInArrow(run, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string").withColumnRenamed("key", key)


def document_proofs(docs: DataFrame, tampered: Column | None = None, *, id_col: str = "doc_id", group_col: str = "source",
                    value_cols: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), height: int = HEIGHT) -> DataFrame:
    """Proof of every row, with ``verified``: whether folding gives the root.

    ``tampered`` is what the last of ``value_cols`` is changed to before the row is folded
    (null where the row is left alone).
    """
    *others, last = (F.col(c) for c in value_cols)
    tampered = F.lit(None).cast("string") if tampered is None else tampered
    group = F.col(group_col).cast("string")
    leaves = materialise(docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("-")).alias("tree"), F.col(id_col).alias("key"), leaf_digest(*others, last).alias("digest"),
        F.col(id_col).alias("id"), F.when(tampered.isNotNull(), leaf_digest(*others, tampered)).alias("changed")))
    found = proofs(merkle_manifest(leaves, ["id", "changed"], height), "id", "changed")
    return found.withColumnRenamed("id", id_col).withColumn("verified", F.col("folded_root") == F.col("root"))
