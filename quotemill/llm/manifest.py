"""Merkle manifest of a dataset: digests of rows, trees of 8 per group, a tree over the groups.

Nodes are built in blocks: aligned subtrees of bounded height, one row each. A block's digests
lie in van Emde Boas order: its tree is cut at half its height into a top tree and bottom trees,
each stored contiguously and cut in the same way again, so a walk between a leaf and the root
touches few pages whatever their size. `address` computes a node's place from its depth and index;
construction and sibling retrieval use nothing else. The roots of a round's blocks are the leaves
of the next round, until each group has one root; the groups' roots are the leaves of a last tree
built alike. Siblings are handed down the same way: a block gets those above its root and hands
each of its leaves these and its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quotemill.llm.common import ranked, saved

ARITY = 8
MOST_HEIGHT = 4  # a block has at most ARITY ** 4 leaves, about 150 kB of digests
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
BLOCK = "grp {kind}, block long, n long, ids array<long>, changed array<binary>, tree binary"
PATH = "grp {kind}, block long, path array<string>, subroot string, root string"


def digest(*fields) -> object:
    """sha256 (hex) over the fields as "-" for null, else "bytes:value"."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def tree_nodes(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes `index` of one depth in the van Emde Boas order of a tree of `levels`."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = ARITY ** (depth - top)  # nodes of this depth in one bottom tree
    inside = address(levels - top, depth - top, index % below)
    return tree_nodes(top) + index // below * tree_nodes(levels - top) + inside


def height_of(n: int) -> int:
    """Levels above n leaves until one node is left."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def widths(leaves: int, height: int) -> list[int]:
    """Nodes at each depth of a block, the root's first."""
    out = [leaves]
    for _ in range(height):
        out.append(-(-out[-1] // ARITY))
    return out[::-1]


def build_block(leaves: np.ndarray, height: int) -> bytes:
    """Digests (rows of 32 bytes) and all nodes above them, in van Emde Boas order."""
    tree = np.zeros((tree_nodes(height + 1), 32), np.uint8)
    at = address(height + 1, height, np.arange(len(leaves)))
    tree[at] = leaves
    for depth in range(height - 1, -1, -1):
        children = tree[at].tobytes()
        step = 32 * ARITY
        hashes = b"".join(sha256(children[i : i + step].hex().encode()).digest() for i in range(0, len(children), step))
        at = address(height + 1, depth, np.arange(len(hashes) // 32))
        tree[at] = np.frombuffer(hashes, np.uint8).reshape(-1, 32)
    return tree.tobytes()


def block_paths(tree: bytes, leaves: int, height: int, above: list[str]) -> list[list[str]]:
    """Per leaf: the hex digests of its siblings left and right of it, level by level, then `above`."""
    nodes = np.frombuffer(tree, np.uint8).reshape(-1, 32)
    paths = [above]
    for depth, width in enumerate(widths(leaves, height)[1:], 1):
        digests = nodes[address(height + 1, depth, np.arange(width))].tobytes().hex()
        run = 64 * ARITY
        next_paths = []
        for i in range(width):
            start = i // ARITY * run
            next_paths.append([digests[start : 64 * i], digests[64 * i + 64 : start + run], *paths[i // ARITY]])
        paths = next_paths
    return paths


def fold(leaf: str, path: list[str]) -> str:
    for left, right in zip(path[::2], path[1::2]):
        leaf = sha256((left + leaf + right).encode()).hexdigest()
    return leaf


@dataclass
class Forest:
    """Trees of all groups: per round a stored table of blocks, and each group's root."""

    height: int  # of a block
    rounds: list[DataFrame]
    roots: DataFrame  # grp, n (leaves), digest (binary)
    kind: str  # type of grp


def grow(nodes: DataFrame, kind: str, label: str) -> Forest:
    """The forest over (grp, pos, id, digest, changed); pos runs from 0 within each group."""
    sizes = saved(nodes.groupBy("grp").agg(F.count("*").alias("n")), f"{label}-sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    height = min(MOST_HEIGHT, max(1, -(-height_of(most) // 2)))
    span = ARITY**height

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n = rows["n"][0].as_py()
        leaves = np.frombuffer(b"".join(rows["digest"].to_pylist()), np.uint8).reshape(-1, 32)
        tree = build_block(leaves, height if n > span else height_of(n))
        one = rows.slice(0, 1)
        lists = [pa.array([rows[c].to_pylist()], pa.list_(k)) for c, k in (("id", pa.int64()), ("changed", pa.binary()))]
        columns = [one["grp"], one["block"], one["n"], *lists, pa.array([tree], pa.binary())]
        return pa.Table.from_arrays(columns, ["grp", "block", "n", "ids", "changed", "tree"])

    build.__annotations__ = {"rows": pa.Table, "return": pa.Table}
    rounds = []
    of = sizes.select(F.col("grp").alias("g"), "n")
    level = nodes.join(of, F.col("grp").eqNullSafe(F.col("g"))).drop("g")
    roots = None
    while True:
        left = F.ceil(F.col("n") / F.lit(span)).cast("long")  # nodes of the group after this round
        grouped = level.withColumn("block", F.floor(F.col("pos") / span).cast("long"))
        blocks = saved(grouped.groupBy("grp", "block").applyInArrow(build, BLOCK.format(kind=kind)), f"{label}-{len(rounds)}")
        rounds.append(blocks)
        none = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("changed")]
        level = blocks.select("grp", F.col("block").alias("pos"), left.alias("n"), F.substring("tree", 1, 32).alias("digest"), *none)
        done = level.where("n = 1").select("grp", "digest")
        roots = done if roots is None else roots.unionByName(done)
        most = -(-most // span)
        if most <= 1:
            break
        level = level.where("n > 1")
    first = sizes.select(F.col("grp").alias("g"), "n")
    return Forest(height, rounds, saved(roots.join(first, F.col("grp").eqNullSafe(F.col("g"))).select("grp", "n", "digest"), f"{label}-roots"), kind)


def hand_down(forest: Forest, tops: DataFrame, label: str) -> DataFrame:
    """(grp, block, path, subroot, root) of the first round's blocks; `tops` has (grp, path, subroot, root) per group."""
    span = ARITY**forest.height
    ended = [F.col("n") <= span ** (r + 1) for r in range(len(forest.rounds))]
    size = forest.roots.select(F.col("grp").alias("g"), "n")
    tops = saved(tops.join(size, F.col("grp").eqNullSafe(F.col("g"))).drop("g"), f"{label}-tops")
    paths = None
    for r in range(len(forest.rounds) - 1, -1, -1):
        here = tops.where(ended[r] & ~ended[r - 1] if r else ended[0])
        here = here.select("grp", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        paths = here if paths is None else here.unionByName(paths)
        paths = saved(paths, f"{label}-paths-{r}")
        if r:
            paths = below(forest, r, paths).mapInArrow(_inner_paths(forest.height), PATH.format(kind=forest.kind))
    return paths


def below(forest: Forest, r: int, paths: DataFrame) -> DataFrame:
    """The blocks of round r with what lies above them."""
    named = paths.select(F.col("grp").alias("g"), F.col("block").alias("b"), "path", "subroot", "root")
    blocks = forest.rounds[r]
    return blocks.join(named, blocks["grp"].eqNullSafe(F.col("g")) & (blocks["block"] == F.col("b"))).drop("g", "b")


def _block_shape(row: dict, height: int) -> tuple[int, int]:
    """Leaves and height of a block."""
    span = ARITY**height
    return min(span, row["n"] - row["block"] * span), height if row["n"] > span else height_of(row["n"])


def _inner_paths(height: int):
    def run(stream):
        for batch in stream:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                row = part.to_pylist()[0]
                leaves, own = _block_shape(row, height)
                paths = block_paths(row["tree"], leaves, own, row["path"])
                first = row["block"] * ARITY**height
                repeat = lambda name: pa.chunked_array([part.column(name)] * leaves).combine_chunks()
                columns = [repeat("grp"), pa.array(range(first, first + leaves), pa.int64()), pa.array(paths, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, repeat("subroot"), repeat("root")], ["grp", "block", "path", "subroot", "root"])

    return run


@dataclass
class Manifest:
    """The stored trees of a dataset."""

    rows: Forest  # per group
    groups: Forest  # over the groups' roots; grp is 0, the ids are the groups' places
    places: DataFrame  # grp, pos: the order of the groups


def manifest(docs: DataFrame, fields: list[str] = FIELDS, key: str = "doc_id", group: str = "lang", changed=None) -> Manifest:
    """The manifest of `docs`: leaves are the digests of `fields`, per group in the order of `key`.

    `changed(row digest)` may give a second digest per row, a column that is null where the row is
    as it was; `proofs` folds it instead of the leaf. Rows that share a key are ordered by their
    digests; equal rows are leaves of their own; a null key comes first; null is a group. An empty
    table gives no groups. Other columns are ignored.
    """
    kind = docs.schema[group].dataType.simpleString()
    leaf = F.unhex(digest(*[F.col(f) for f in fields])).alias("digest")
    other = F.lit(None).cast("binary") if changed is None else F.unhex(changed(docs))
    leaves = saved(docs.select(F.col(group).alias("grp"), F.col(key).cast("long").alias("id"), leaf, other.alias("changed")), "manifest-leaves")
    rows = grow(ranked(leaves, "grp", ["id", "digest"], "manifest-ranked"), kind, "manifest")
    of = rows.roots.select("grp", "digest", F.lit(0).cast("long").alias("all"))
    placed = saved(ranked(of, "all", ["grp"], "manifest-groups"), "manifest-places")
    none = F.lit(None).cast("binary").alias("changed")
    nodes = placed.select(F.col("all").alias("grp"), "pos", F.col("pos").alias("id"), "digest", none)
    return Manifest(rows, grow(nodes, "bigint", "manifest-top"), placed.select("grp", "pos", "digest"))


def proofs(made: Manifest) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The proof digest runs over the siblings from the leaf's level to the root, left to right. The
    folded root is recomputed from the row's changed digest, else its leaf, and its siblings.
    """
    root = made.groups.roots.select(F.lower(F.hex("digest")).alias("root"), F.col("grp").alias("all"))
    above = F.array().cast("array<string>").alias("path")
    start = root.select(F.col("all").alias("grp"), above, F.col("root").alias("subroot"), "root")
    paths = hand_down(made.groups, start, "manifest-top")
    per_group = below(made.groups, 0, paths).mapInArrow(_inner_paths(made.groups.height), PATH.format(kind="bigint"))
    named = per_group.select(F.col("block").alias("place"), "path", "root")
    tops = made.places.join(named, F.col("pos") == F.col("place"))
    tops = tops.select("grp", "path", F.lower(F.hex("digest")).alias("subroot"), "root")
    paths = hand_down(made.rows, tops, "manifest")
    height = made.rows.height

    def run(stream):
        for batch in stream:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                leaves, own = _block_shape(row, height)
                at = address(own + 1, own, np.arange(leaves))
                hexes = np.frombuffer(row["tree"], np.uint8).reshape(-1, 32)[at].tobytes().hex()
                names = [hexes[64 * j : 64 * j + 64] for j in range(leaves)]
                sums, folded = [], []
                for name, other, path in zip(names, row["changed"], block_paths(row["tree"], leaves, own, row["path"])):
                    sums.append(sha256("".join(path).encode()).hexdigest())
                    folded.append(fold(name if other is None else other.hex(), path))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["ids"], pa.int64()), "leaf": names, "subroot": [row["subroot"]] * leaves,
                        "root": [row["root"]] * leaves, "proof_sha256": sums, "folded_root": folded,
                    }
                )

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return below(made.rows, 0, paths).mapInArrow(run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered_every_third(docs: DataFrame):
    """The digest of a row whose text is lower-cased (A-Z) if 3 divides the crc32 of its id, else null."""
    fields = [F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, digest(*fields))
