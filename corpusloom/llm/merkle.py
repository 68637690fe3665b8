"""Merkle manifest of a data set as a persistent tree with path copying.

Leaves stand in aligned blocks of 2^k. A block builds its part of the tree once;
each edited leaf makes a version of it that copies the ancestors of that leaf and
shares every other node. Block roots are the leaves of the next layer, and so on
up to the root of a group and then of all groups. Above its block a version goes
on by itself: it meets the siblings of its block's path and copies the remaining
ancestors, so versions are dealt over all tasks and never gathered.

A path is kept as bytes, one step per level: ``L`` or ``R`` and the digest of the
sibling on that side, or ``-`` where a node stands alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import runs_of, written
from corpusloom.operators.positions import with_positions

#: A block holds 2^LEVELS neighbouring nodes.
LEVELS = 10
_DIGEST = 32


def parent(*nodes: bytes) -> bytes:
    """Digest of the nodes' hexadecimal digests, one behind the other."""
    return sha256("".join(n.hex() for n in nodes).encode()).digest()


def record_hash(fields: Sequence[Column]) -> Column:
    """SHA-256 (binary) of a row: ``-`` per null field, else its length in bytes, a colon and its text."""
    told = []
    for field in fields:
        plain = field.cast("string")
        told.append(F.when(plain.isNull(), "-").otherwise(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain)))
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


class Block:
    """The nodes above some neighbouring leaves; versions share what an edit does not touch."""

    def __init__(self, leaves: list[bytes], levels: int):
        self.layers = [leaves]
        for _ in range(levels):
            below = self.layers[-1]
            self.layers.append([parent(*below[k : k + 2]) for k in range(0, len(below), 2)])

    @property
    def root(self) -> bytes:
        return self.layers[-1][0]

    def path(self, leaf: int) -> bytes:
        steps = []
        for layer in self.layers[:-1]:
            other = leaf ^ 1
            if other < len(layer):
                steps.append((b"L" if leaf & 1 else b"R") + layer[other])
            else:
                steps.append(b"-")
            leaf >>= 1
        return b"".join(steps)

    def version(self, leaf: int, digest: bytes) -> bytes:
        """Root of the version in which ``leaf`` has another digest: only its ancestors are new nodes."""
        for layer in self.layers[:-1]:
            other = leaf ^ 1
            if other >= len(layer):
                digest = parent(digest)
            else:
                digest = parent(layer[other], digest) if leaf & 1 else parent(digest, layer[other])
            leaf >>= 1
        return digest


def steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(path):
        side = path[at : at + 1]
        width = 0 if side == b"-" else _DIGEST
        yield side, path[at + 1 : at + 1 + width]
        at += 1 + width


def folded(digest: bytes, path: bytes) -> bytes:
    """Root that a node and the steps above it give."""
    for side, other in steps(path):
        digest = parent(digest) if side == b"-" else parent(other, digest) if side == b"L" else parent(digest, other)
    return digest


def proof_digest(*paths: bytes) -> str:
    """SHA-256 (hexadecimal) of the siblings along the paths, as hexadecimal text."""
    return sha256("".join(other.hex() for path in paths for _, other in steps(path)).encode()).hexdigest()


_BLOCK_SCHEMA = "tree bigint, block bigint, position bigint, leaf binary, path binary, root binary, version_root binary"
_DONE_SCHEMA = "of string, leaf binary, subroot binary, root binary, path binary, proof_sha256 string, folded_root binary"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _grow(levels: int) -> Callable:
    """The path of each node to the root of its block, that root, and the root of the node's own version."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_ in runs_of(batches, ["tree", "block"]):
            leaves = run_.column("digest").to_pylist()
            nodes, height = run_.column("total")[0].as_py(), 0
            while nodes > 1 and height < levels:
                nodes, height = (nodes + 1) // 2, height + 1
            block = Block(leaves, height)
            versions = [
                block.root if edit is None else block.version(k, edit) for k, edit in enumerate(run_.column("edited").to_pylist())
            ]
            made = [
                run_.column("tree"), run_.column("block"), run_.column("position"), pa.array(leaves, pa.binary()),
                pa.array([block.path(k) for k in range(len(leaves))], pa.binary()),
                pa.array([block.root] * len(leaves), pa.binary()), pa.array(versions, pa.binary()), run_.column("name"),
            ]
            made = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made]
            yield pa.RecordBatch.from_arrays(made, [*_names(_BLOCK_SCHEMA), "name"])

    return run


def _unedited() -> list[Column]:
    """Columns that only leaves fill."""
    return [F.lit(None).cast("binary").alias("edited"), F.lit(None).cast("string").alias("name")]


def _layer(nodes: DataFrame, levels: int) -> DataFrame:
    """One layer of blocks over nodes (tree, position, total, digest, edited, name); ``name`` is carried along."""
    kind = nodes.schema["name"].dataType.simpleString()
    dealt = nodes.withColumn("block", F.shiftright("position", levels)).repartition("tree", "block")
    return written(
        dealt.sortWithinPartitions("tree", "block", "position")
        .select("tree", "block", "position", "total", "digest", "edited", "name")
        .mapInArrow(_grow(levels), f"{_BLOCK_SCHEMA}, name {kind}"),
        "tree-layer",
    )


def _forest(nodes: DataFrame, largest: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Lowest layer of the trees over ``nodes``, and per block of it (tree, block, above, top): its path to the tree's root."""
    layers = [_layer(nodes, levels)]
    while largest > 1 << levels:
        largest = -(-largest >> levels)
        # The first row of a block speaks for it; the tree's number of nodes follows from the last block.
        blocks = layers[-1].where(F.col("position") == F.shiftleft("block", levels))
        sizes = blocks.groupBy("tree").agg((F.max("block") + 1).alias("total"))
        layers.append(
            _layer(
                blocks.join(sizes, "tree").select(
                    "tree", F.col("block").alias("position"), "total", F.col("root").alias("digest"), *_unedited()
                ),
                levels,
            )
        )
    first = layers[-1].where(F.col("position") == F.shiftleft("block", levels))
    above = first.select("tree", "block", F.lit(b"").alias("above"), F.col("root").alias("top"))
    for layer in reversed(layers[1:]):
        above = written(
            layer.join(above, ["tree", "block"]).select(
                "tree", F.col("position").alias("block"), F.concat("path", "above").alias("above"), "top"
            ),
            "tree-paths",
        )
    return layers[0], above


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[bytes, bytes], bytes] = {}
    for batch in batches:
        known.clear()
        proofs, tops = [], []
        columns = [batch.column(c).to_pylist() for c in ("path", "above", "version_root")]
        for path, above, version in zip(*columns, strict=True):
            proofs.append(proof_digest(path, above))
            key = (version, above)
            if key not in known:
                known[key] = folded(version, above)
            tops.append(known[key])
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(n) for n in ("of", "leaf", "subroot", "root")],
                pa.array([a + b for a, b in zip(columns[0], columns[1], strict=True)], pa.binary()),
                pa.array(proofs, pa.string()), pa.array(tops, pa.binary()), batch.column("name"),
            ],
            [*_names(_DONE_SCHEMA), "name"],
        )


def manifest(
    docs: DataFrame,
    fields: Sequence[str],
    group: str,
    order: str,
    edits: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per input row: ``order``, ``group``, leaf, subroot, root, path (to the root), proof_sha256, folded_root.

    Digests are binary, ``path`` is the proof as described above. Leaves are
    digests of ``fields``; per value of ``group`` they ascend by ``order`` (nulls
    first; ties by the leaf's digest) and are joined two by two, a last single
    node by itself, until one remains. The groups' roots, nulls first and then by
    UTF-8 bytes, are joined likewise to ``root``. ``edits`` replaces fields by
    other values, as an edit after the manifest was made would: ``folded_root``
    is the root of the version with that one leaf, and equals ``root`` if the
    leaf did not change.

    The driver sees the size of the largest group and the number of groups. No
    task holds more than one block of 2^levels nodes. Null, empty and long values
    are hashed whole; repeated rows are leaves of their own; other columns are
    not read. An empty table gives an empty result.
    """
    changed = [(edits or {}).get(f, F.col(f)) for f in fields]
    leaf, edited = record_hash([F.col(f) for f in fields]), record_hash(changed)
    differs = F.lit(False)
    for f, new in (edits or {}).items():
        differs = differs | ~F.col(f).eqNullSafe(new)
    leaves = written(
        docs.select(
            F.col(group).cast("string").alias("of"), F.col(order).alias("name"),
            leaf.alias("digest"), F.when(differs, edited).alias("edited"),
        ),
        "leaves",
    )
    placed = written(with_positions(leaves, ["name", "digest"], within=["of"], total="total", group="tree"), "placed-leaves")
    largest, trees = placed.agg(F.max("total"), F.max("tree") + 1).first()
    lowest, above = _forest(placed, largest or 0, levels)
    subroots = above.where("block = 0").select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("position"), F.lit(trees or 0).cast("bigint").alias("total"),
        F.col("top").alias("digest"), *_unedited(),
    )
    joined, over = _forest(written(subroots, "subroots"), trees or 0, levels)
    # One row per group: the way up from its root, and its name.
    by_tree = written(
        joined.join(over, ["tree", "block"])
        .select(F.col("position").alias("tree"), F.concat("path", "above").alias("over"), F.col("leaf").alias("subroot"), F.col("top").alias("root"))
        .join(placed.where("position = 0").select("tree", "of"), "tree"),
        "group-paths",
    )
    # Per block of leaves: the whole way up from its root.
    ways = written(
        above.join(by_tree, "tree").select("tree", "block", F.concat("above", "over").alias("above"), "subroot", "root", "of"), "block-paths"
    )
    kind = placed.schema["name"].dataType.simpleString()
    return (
        lowest.drop("root").join(ways, ["tree", "block"])
        .select("leaf", "path", "above", "version_root", "subroot", "root", "of", "name")
        .mapInArrow(_finish, f"{_DONE_SCHEMA}, name {kind}")
        .select(
            F.col("name").alias(order), F.col("of").alias(group), "leaf", "subroot", "root", "path", "proof_sha256", "folded_root"
        )
    )
