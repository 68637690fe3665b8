"""MinHash near-de-duplication with circulant permutations.

One permutation (a fixed bijection of 32-bit numbers) scatters the shingles, a
second one, read at circular shifts 0, 1, 2, ..., gives every coordinate of the
signature. Coordinates are banded; texts that share a band are candidates, and
links are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WordHashes, components, lower_words, mix, runs_of, shingles, written

#: Buckets with more classes are compared in blocks of about this many.
BLOCK = 1_024


def _scatter(values: np.ndarray) -> np.ndarray:
    """The first permutation: shingle hashes to places 0 .. 2^32 - 1."""
    return (mix(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def circulant_signature(values: np.ndarray, size: int, block: int = 4096) -> np.ndarray:
    """Coordinate k is the least place under the second permutation read k steps further on."""
    places, shifts = _scatter(values), np.arange(size, dtype=np.uint32)[:, None]
    best = np.full(size, np.uint32(0xFFFFFFFF))
    for at in range(0, len(places), block):
        v = places[None, at : at + block] + shifts
        v ^= v >> np.uint32(16)
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        v *= np.uint32(0xC2B2AE35)
        v ^= v >> np.uint32(16)
        np.minimum(best, v.min(axis=1), out=best)
    return best


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts, keys = signature.reshape(bands, rows).astype(np.uint64), mix(np.arange(bands, dtype=np.uint64))
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return keys.view(np.int64)


def _digest(found: np.ndarray) -> int | None:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())))) if len(found) else None


def _describe(words: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes.shared()
        for batch in batches:
            counts, digests, keys = [], [], []
            for text in batch.column(1).to_pylist():
                found = np.unique(shingles(known.of(lower_words(text)), words))
                counts.append(len(found))
                digests.append(_digest(found))
                keys.append(band_keys(circulant_signature(found, bands * rows), bands, rows) if len(found) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(digests, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc", "row", "n_shingles", "id", "bands"],
            )

    return run


def _sets(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes.shared()
        for batch in batches:
            found = [np.unique(shingles(known.of(lower_words(t)), words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_digest, found), pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))],
                ["id", "members"],
            )

    return run


def _across(percent: int) -> Callable:
    """Of the classes of a bucket (or of two blocks of it): a confirmed link for each pair of labels that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, ["key", "low", "high"]):
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            ids, label, side = (group.column(n).to_numpy() for n in ("id", "label", "part"))
            lists = group.column("members").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            terms, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            names, counts = np.unique(label, return_counts=True)
            odd = np.flatnonzero(label != names[np.argmax(counts)])  # the pairs of two labels include one of these
            marked, found = np.zeros(len(terms), np.int64), {}
            for k in odd.tolist():
                marked[place[starts[k] : starts[k] + sizes[k]]] = 1
                common = np.add.reduceat(marked[place], starts)
                marked[place[starts[k] : starts[k] + sizes[k]]] = 0
                fits = (common * 100 >= (sizes + sizes[k] - common) * percent) & (label != label[k])
                if low != high:
                    fits &= side != side[k]
                for j in np.flatnonzero(fits).tolist():
                    found.setdefault(tuple(sorted((label[k], label[j]))), (ids[k], ids[j]))
            if found:
                a, b = zip(*found.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b")).cast("bigint")
    union = F.size("of_a") + F.size("of_b") - common
    return written(
        pairs.join(left, "a").join(right, "b").where(common * 100 >= union * percent).select("a", "b"), "confirmed"
    )


def minhash_dedup(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    words: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
    row_column: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, class_id, and ``row_column`` if given.

    Words are separated by ASCII white space, A-Z in lower case. Documents link
    when 100 * |intersection| >= percent * |union| of their sets of ``words``-word
    shingles (a shorter text is one shingle). component_id is the smallest id
    reachable over links, kept marks that row.

    Rows with equal sets form a class. Within a band's bucket every class is
    first compared with one leader; then the classes of a bucket that are still
    in different components are compared with each other, a bucket at a time and
    in blocks, and one link of each pair of components is kept. So no link
    between components is lost, and no pairs are written out.
    A pair at the threshold shares no band with probability below 1e-6 at the
    default and the registered settings.

    Null texts and texts without words have the empty set and link with nothing.
    A row with a null id links with nothing and has a null component, not kept.
    Rows that repeat an id have the component of that id. An empty table gives
    an empty result. Other columns are not read.
    """
    row = F.col(row_column) if row_column else F.lit(None)
    source = docs.select(
        F.col(id_column).alias("doc"), F.col(text).cast("string").alias("text"), row.cast("bigint").alias("row")
    )
    kind = source.schema["doc"].dataType.simpleString()
    # From here on "id" is the 64-bit hash of a shingle set: rows with equal sets are one class.
    described = written(
        source.mapInArrow(
            _describe(words, bands, rows), f"doc {kind}, row bigint, n_shingles bigint, id bigint, bands array<bigint>"
        ),
        "signatures",
    )
    classes = written(
        described.where("id IS NOT NULL AND doc IS NOT NULL")
        .groupBy("id")
        .agg(F.min("doc").alias("first_doc"), F.first("bands").alias("bands")),
        "classes",
    )
    keys = classes.select("id", "first_doc", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(keys.join(shared, "key").select("key", "id", "leader", "first_doc"), "buckets")
    wanted = written(members.select("id", "first_doc").distinct(), "candidates")
    sets = written(
        # The candidates grow with the table, so they are merged at every size and never broadcast.
        source.join(wanted.select(F.col("first_doc").alias("doc")).distinct().hint("merge"), "doc", "left_semi")
        .mapInArrow(_sets(words), "id bigint, members array<bigint>")
        .join(wanted.select("id"), "id", "left_semi")
        .dropDuplicates(["id"]),
        "sets",
    )
    tested = written(members.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = _confirmed(tested, sets, percent)
    labelled = members.join(components(links), "id", "left").select(
        "key", "id", F.coalesce("component_id", "id").alias("label")
    )
    # Close texts share many bands: of buckets with the same classes, one is enough.
    mixed = (
        labelled.groupBy("key")
        .agg(
            F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("id")).alias("one"), F.bit_xor(F.xxhash64("id", F.lit(11))).alias("two"),
        )
        .where("least < most").groupBy("n", "one", "two").agg(F.min("key").alias("key"))
    )
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    entries = (
        labelled.join(written(mixed.select("key", blocks.alias("blocks")), "mixed"), "key")
        .withColumn("part", part)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "id", "label")
        .join(sets, "id")
    )
    across = written(
        entries.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        .mapInArrow(_across(percent), "a bigint, b bigint"),
        "across",
    )
    links = links.unionByName(across)
    labels = classes.select("id", "first_doc").join(components(links), "id", "left").withColumn(
        "label", F.coalesce("component_id", "id")
    )
    smallest = labels.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    by_class = labels.select("id", "first_doc", "label").join(smallest, "label").drop("label")
    has_id = F.col("doc").isNotNull()
    own = F.when(has_id, F.coalesce("component_id", "doc"))
    return (
        described.select("doc", "row", "n_shingles", "id")
        .join(by_class, "id", "left")
        .select(
            F.col("doc").alias(id_column), "n_shingles", own.alias("component_id"),
            F.coalesce(F.col("doc") == own, F.lit(False)).alias("kept"),
            F.when(has_id, F.coalesce("first_doc", "doc")).alias("class_id"),
            *([F.col("row").alias(row_column)] if row_column else []),
        )
    )
