"""Near-duplicate vectors with a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order. Near
vectors have most of them in common, so they meet in the inverted lists of pairs
of pivots: to share a list is to share at least two pivots. All pairs that meet
are verified by cosine, in blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import components, mix, written

#: Nearest pivots that describe a vector; every pair of them is a key.
NEAREST = 7
#: Pivots: twice the root of the number of different vectors, within these bounds.
PIVOTS = (64, 16_384)
#: Longer lists are compared in blocks of about this many vectors.
BLOCK = 1_024
COSINE = 0.95
#: Pivots are no nearer to each other than this.
PIVOT_COSINE = 0.9


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def pivot_order(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of unit vectors, nearest first."""
    near = vectors @ pivots.T
    k = min(nearest, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def spread_pivots(vectors: np.ndarray, cosine: float = PIVOT_COSINE) -> np.ndarray:
    """The vectors without those near an earlier one: a large group of near copies gives one pivot."""
    kept = np.zeros(len(vectors), bool)
    for k in range(len(vectors)):
        kept[k] = not (vectors[:k][kept[:k]] @ vectors[k] >= cosine).any()
    return vectors[kept]


def _pair_key(dim: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix(mix(low.astype(np.uint64) + np.uint64(dim << 32)) + high.astype(np.uint64)).view(np.int64)


def _describe(held, nearest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = pickle.loads(held.value)
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                top = np.sort(pivot_order(_unit(_matrix(part.column(2), int(dim))), pivots[int(dim)], nearest), axis=1)
                pairs = list(combinations(range(top.shape[1]), 2))
                keys = np.stack([_pair_key(int(dim), top[:, i], top[:, j]) for i, j in pairs], axis=1) if pairs else np.empty((len(top), 0), np.int64)
                if not pairs:  # a single pivot: all vectors of this length meet
                    keys = np.full((len(top), 1), int(dim))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(list(top.astype(np.int32)), pa.list_(pa.int32())),
                     pa.array(list(keys), pa.list_(pa.int64()))],
                    ["id", "size", "vector", "top", "keys"],
                )

    return run


def _first_meeting(a: np.ndarray, b: np.ndarray, dim: int, key: int) -> np.ndarray:
    """Whether the list is the one of the two smallest pivots that the rows have in common."""
    if a.shape[1] < 2:
        return np.ones(len(a), bool)
    common = (a[:, :, None] == b[:, None, :]).any(axis=2)
    order = np.argsort(~common, axis=1, kind="stable")[:, :2]
    two = np.take_along_axis(a, order, 1)
    return _pair_key(dim, two[:, 0], two[:, 1]) == key


def _spanning(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Least row number reachable over the links, per row."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(cosine: float) -> Callable:
    """Rows sorted by (key, low, high), one group after the other: links per vector and links that span them."""

    def links_of(group: pa.Table) -> pa.RecordBatch | None:
        own, low, high = (group.column(n)[0].as_py() for n in ("key", "low", "high"))
        ids, sizes = group.column("id").to_numpy(), group.column("size").to_numpy()
        side = group.column("block").to_numpy()
        vectors = group.column("vector").combine_chunks()
        dim = len(vectors[0])
        unit = _unit(_matrix(vectors, dim))
        top = _matrix(group.column("top").combine_chunks(), len(group.column("top")[0])).astype(np.int64)
        rows, columns = (np.flatnonzero(side == low), np.flatnonzero(side == high))
        left, right = [], []
        for k in range(0, len(rows), 256):
            i, j = np.nonzero(unit[rows[k : k + 256]] @ unit[columns].T >= cosine - 1e-9)
            i, j = rows[k + i], columns[j]
            if low == high:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 65_536):
                a, b = i[at : at + 65_536], j[at : at + 65_536]
                fits = _first_meeting(top[a], top[b], dim, own)
                a, b = a[fits], b[fits]
                fits = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                left.append(a[fits])
                right.append(b[fits])
        left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        if not len(left):
            return None
        counts = np.bincount(left, sizes[right], len(ids)) + np.bincount(right, sizes[left], len(ids))
        root = _spanning(left, right, len(ids))
        hit = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[hit]), pa.array(ids[root[hit]]), pa.array(counts[hit].astype(np.int64))], ["a", "b", "links"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            names = [batch.column(n).to_numpy() for n in ("key", "low", "high")]
            if rest:
                last = [rest[-1].column(n)[-1].as_py() for n in ("key", "low", "high")]
                names = [np.concatenate([[v], x]) for v, x in zip(last, names, strict=True)]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + (0 if rest else 1)
            start = 0
            for at in change.tolist():
                rest.append(batch.slice(start, at - start))
                if sum(map(len, rest)) > 1 and (out := links_of(pa.Table.from_batches(rest))) is not None:
                    yield out
                rest, start = [], at
            rest.append(batch.slice(start))
            rest = [r for r in rest if len(r)]
        if rest and sum(map(len, rest)) > 1 and (out := links_of(pa.Table.from_batches(rest))) is not None:
            yield out

    return run


def embedding_dedup(
    vectors: DataFrame, vector: str = "embedding", id_column: str = "vec_id", cosine: float = COSINE,
    nearest: int = NEAREST, block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    n_links counts the other rows whose cosine reaches ``cosine`` among those
    that share two of the ``nearest`` pivots; component_id is the smallest id
    reachable over such links. Equal vectors are compared once and counted by
    their number. Lists longer than ``block`` are cut into blocks and every pair
    of blocks is compared in a task of its own, so none is dropped.

    The pivots are the vectors with the smallest hashes, at most the upper bound
    of ``PIVOTS`` of each length; vectors of different lengths never link. Null,
    empty and zero vectors and those with null or non-finite components have no
    links and are their own component. A row with a null id takes part, but is
    never kept. An empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).alias("vec"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("id", F.when(F.coalesce(fine & F.exists("v", lambda x: x != 0), F.lit(False)), F.xxhash64("v")))
    classes = written(
        rows.where("id IS NOT NULL").groupBy("id").agg(
            F.count(F.lit(1)).alias("size"), F.first("v").alias("vector"), F.min("vec").alias("first_vec")
        ).withColumn("dim", F.size("vector")),
        "vectors",
    )
    counts = {r.dim: r["count"] for r in classes.groupBy("dim").count().collect()}
    pivots = {}
    for dim, n in counts.items():
        wanted = int(min(max(PIVOTS[0], 2 * n**0.5), PIVOTS[1]))
        chosen = classes.where(F.col("dim") == dim).orderBy("id").limit(wanted).select("vector").collect()
        pivots[dim] = spread_pivots(_unit(np.array([r.vector for r in chosen])))
    held = spark.sparkContext.broadcast(pickle.dumps(pivots))
    index = written(
        classes.select("id", "size", "vector", "dim").mapInArrow(
            _describe(held, nearest), "id bigint, size bigint, vector array<double>, top array<int>, keys array<bigint>"
        ),
        "index",
    )
    lists = index.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1")
    lists = written(lists.select("key", F.ceil(F.col("count") / F.lit(block)).cast("int").alias("blocks")), "lists")
    entries = (
        index.select("id", "size", "vector", "top", F.explode("keys").alias("key"))
        .join(lists, "key")
        .withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "id", "size", "vector", "top")
    )
    found = written(
        entries.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        .mapInArrow(_verify(cosine), "a bigint, b bigint, links bigint"),
        "links",
    )
    n_links = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    labels = (
        classes.select("id", "size", "first_vec")
        .join(n_links, "id", "left")
        .join(components(found.select("a", "b")), "id", "left")
        .withColumn("label", F.coalesce("component_id", "id"))
    )
    smallest = labels.groupBy("label").agg(F.min("first_vec").alias("least"))
    by_class = labels.drop("component_id").join(smallest, "label").select("id", "size", "links", "least")
    own = F.when(F.col("id").isNull(), F.col("vec")).otherwise(F.col("least"))
    return rows.select("vec", "id").join(by_class, "id", "left").select(
        F.col("vec").alias(id_column),
        F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("bigint").alias("n_links"),
        own.alias("component_id"), F.coalesce(F.col("vec") == own, F.lit(False)).alias("kept"),
    )
