"""Helpers shared by the training-data operators: written tables, components, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.positions import free_name
from corpusloom.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder.

    Cuts the lineage: a lost executor costs a read of the table, not the work
    behind it.
    """
    path = scratch_path(df.sparkSession, label)
    if _TEMPORARY:
        _TEMPORARY[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_TEMPORARY: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`written` makes inside are deleted at the end.

    For a caller that has written its own result by then (after the ``with``
    begins to close, nothing may read those tables any more): see :func:`settled`.
    """
    _TEMPORARY.append([])
    try:
        yield
    finally:
        configuration = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _TEMPORARY.pop():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(configuration).delete(place, True)


def settled(make: Callable[[], DataFrame], spark: SparkSession, label: str) -> DataFrame:
    """The rows of ``make()`` as a written table; the tables written on the way are deleted."""
    path = scratch_path(spark, label)
    with temporary_tables(spark):
        make().write.parquet(path)
    return spark.read.parquet(path)


def numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart, and the name of that column.

    Rows of a plain table of files are known by file and place in it, which every
    read of the table gives alike. Other rows are numbered and written.
    """
    name = free_name(docs, "row_")
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        meta = docs.metadataColumn("_metadata")
        path, place = meta.getField("file_path"), meta.getField("row_index")
        files = docs.select(path.alias("path")).distinct().agg(F.count("path"), F.count_distinct(F.xxhash64("path"))).first()
        if files[0] == files[1]:
            return docs.withColumn(name, F.struct(F.xxhash64(path).alias("file"), place.alias("place"))), name
    return written(docs.withColumn(name, F.monotonically_increasing_id()), label), name


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal integer ``keys``, of rows that come sorted by them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        values = [batch.column(n).to_numpy() for n in keys]
        if rest:
            last = [rest[-1].column(n)[-1].as_py() for n in keys]
            values = [np.concatenate([[v], x]) for v, x in zip(last, values, strict=True)]
        starts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in values], axis=0)) + (0 if rest else 1)
        begin = 0
        for at in starts.tolist():
            if rest or at > begin:
                rest.append(batch.slice(begin, at - begin))
                yield pa.Table.from_batches(rest)
            rest, begin = [], at
        rest.append(batch.slice(begin))
    if rest:
        yield pa.Table.from_batches(rest)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links as (id, component_id), the smallest id reachable.

    Alternates the two star contractions (every neighbour is tied to the
    smallest one) until the links no longer change; each step is an aggregate
    and an equi-join, so a hub is combined before the shuffle and split by AQE
    after it. Ids without a link do not appear. Null ends are ignored.
    """
    edges = written(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
        .distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        ).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                      F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a != b").distinct()
        )
        edges = written(small, "links")
        before, state = state, _state(edges)
        if state == before:
            break
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return stars.unionByName(stars.select(F.col("component_id").alias("id"), "component_id").distinct())


_MEMORIES: list[dict] = []


def sole_memory(memory: dict | None = None) -> None:
    """What a Python worker remembers for other operators is dropped, so that it holds one operator's words at a time."""
    for other in _MEMORIES:
        if other is not memory:
            other.clear()
    if memory is not None and not any(other is memory for other in _MEMORIES):
        _MEMORIES.append(memory)


_SHARED: list[WordHashes] = []


class WordHashes(dict):
    """Eight hash bytes of each word, remembered; emptied when it grows past ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    @classmethod
    def shared(cls) -> WordHashes:
        """The one of this process, so that what it remembers serves later tasks too."""
        if not _SHARED:
            _SHARED.append(cls())
        sole_memory(_SHARED[0])
        return _SHARED[0]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_digest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=np.uint64)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(values: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * _M1
    values = (values ^ (values >> np.uint64(27))) * _M2
    return values ^ (values >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; of a shorter text, of all its words as one run."""
    if not len(hashes):
        return hashes
    width_here = min(width, len(hashes))
    count = len(hashes) - width_here + 1
    out = np.full(count, width_here, dtype=np.uint64)
    for k in range(width_here):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count])
    return out


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case and nothing else changed."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def sql_word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


#: Bytes that separate terms become a space, A-Z become a-z, all others stay.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def portions(batches: Iterator[pa.RecordBatch], text: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in order, in pieces of about ``size`` bytes of the column ``text`` (a longer text is a piece of its own)."""
    for batch in batches:
        if not len(batch):
            continue
        column = batch.column(text)
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(batch):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


_BASE, _SLICE = 0x9E3779B97F4A7C15, 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of ``_BASE`` and of its inverse modulo 2^64, kept for slices of the usual size."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        both.append(np.multiply.accumulate(factors))
    if n <= 2 * _SLICE:
        _POWERS[:] = both
    return both[0], both[1]


def hashed_terms(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of all texts, as arrays: (bytes, begins, ends, hashes, terms per text).

    ``begins`` and ``ends`` are places in ``bytes``, where separators are spaces.
    The hash of a term is a polynomial over its bytes, from running sums, so no
    term becomes an object. Equal terms have equal hashes; the converse is for
    the caller to check.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES) for t in texts]
    data = b" ".join([*parts, b""])
    begins, ends, hashes, at = [], [], [], 0
    while at < len(data):
        stop = len(data)
        if stop - at > _SLICE:  # up to a separator, so that no term is cut
            stop = data.rfind(b" ", at, at + _SLICE) + 1 or data.find(b" ", at + _SLICE) + 1
        here = np.frombuffer(data, np.uint8, stop - at, at)
        edges = np.flatnonzero(np.diff((here != 0x20).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        first, last = edges[::2], edges[1::2]
        up, down = _powers(max(len(here), _SLICE))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((here.astype(np.uint64) + np.uint64(1)) * up[: len(here)])])
        hashes.append(mix((sums[last] - sums[first]) * down[first]))
        begins.append(first + at)
        ends.append(last + at)
        at = stop
    nothing = np.zeros(0, np.int64)
    begins, ends = np.concatenate([nothing, *begins]), np.concatenate([nothing, *ends])
    upto = np.searchsorted(begins, np.cumsum([len(p) + 1 for p in parts], dtype=np.int64))
    return data, begins, ends, np.concatenate([nothing.view(np.uint64), *hashes]), np.diff(upto, prepend=0)
