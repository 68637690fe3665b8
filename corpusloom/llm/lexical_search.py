"""Ranked lexical search with range-maximum tables over posting lists.

Documents stand in shards, sorted by id. A shard holds one posting list per
query term and, over the impacts of each list, a sparse table that tells the
greatest impact of any range in constant time. A query starts from the whole
shard as one interval of documents. The sum of the terms' range maxima bounds
every score inside an interval; the intervals with the highest bounds are split
first, each at a document that attains the largest of its maxima, until no bound
reaches the scores already found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import portions, terms_of, written
from corpusloom.operators.positions import with_positions

TOP = 20
#: Queries are answered in blocks of at most this many items; a block's terms and weights are what tasks hold.
ITEMS_PER_BLOCK = 1_024
#: A shard ends with the document that reaches this many postings.
SHARD_POSTINGS = 500_000
#: Intervals split in one step.
STEP = 48


def _index(vocabulary) -> Callable:
    """Per document with terms: id, n (its terms with repeats), and the query terms it holds with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: k for k, term in enumerate(vocabulary.value)}
        for batch in portions(batches, "text"):
            words = [terms_of(t) for t in batch.column("text").to_pylist()]
            n = np.fromiter(map(len, words), np.int64, len(words))
            flat = np.fromiter((number.get(w, -1) for ws in words for w in ws), np.int64, int(n.sum()))
            owner = np.repeat(np.arange(len(words)), n)
            seen = flat >= 0
            keys, tf = np.unique(owner[seen] * len(number) + flat[seen], return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(words) + 1) * max(len(number), 1)).astype(np.int32)
            keep = np.flatnonzero(n)
            terms = pa.ListArray.from_arrays(pa.array(ends), pa.array((keys % max(len(number), 1)).astype(np.int32)))
            counts = pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int32)))
            out = pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n), terms, counts], ["id", "n", "terms", "tf"]
            )
            yield out.take(pa.array(keep))

    return run


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        here = np.bincount(batch.column("terms").flatten().to_numpy())
        if len(here) > len(total):
            here, total = total, here
        total[: len(here)] += here
    terms = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(total[terms])], ["term", "df"])


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a score that a document and a term decide, before the term's weight (64-bit integers)."""
    m = 75 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Shard:
    """Posting lists of some documents, sorted by id, with a sparse table over the impacts of each list."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, owners: np.ndarray, impact: np.ndarray):
        self.ids, self.size = ids, len(ids)
        order = np.lexsort((owners, terms))
        # Lists stand one behind the other; a range inside one list never reads another's cells.
        self.places = terms[order].astype(np.int64) * self.size + owners[order]
        self.owners, self.impact = owners[order], impact[order]
        longest = int(np.bincount(terms).max()) if len(terms) else 0
        self.best = [np.arange(len(terms), dtype=np.int32)]
        while 2 << (len(self.best) - 1) <= longest:
            half = 1 << (len(self.best) - 1)
            a, b = self.best[-1][:-half], self.best[-1][half:]
            self.best.append(np.where(self.impact[b] > self.impact[a], b, a))

    def range_maximum(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest impact of postings ``low`` to ``high`` (0 if there are none), and the posting that has it."""
        value, at = np.zeros(low.shape, np.int64), np.zeros(low.shape, np.int64)
        width = high - low
        level = np.frexp(width)[1] - 1
        for k, table in enumerate(self.best):
            here = np.nonzero((level == k) & (width > 0))
            if len(here[0]):
                a, b = table[low[here]], table[high[here] - (1 << k)]
                a = np.where(self.impact[b] > self.impact[a], b, a)
                value[here], at[here] = self.impact[a], a
        return value, at

    def search(self, terms: np.ndarray, weight: np.ndarray, top: int, score: np.ndarray, ids: np.ndarray):
        """The ``top`` best of the documents found so far (``score``, ``ids``, best first) and of this shard."""
        base = terms.astype(np.int64) * self.size
        low = np.searchsorted(self.places, base)[None, :]
        high = np.searchsorted(self.places, base + self.size)[None, :]
        begin = np.zeros(1, np.int64)
        maxima, at = self.range_maximum(low, high)
        bound = maxima @ weight
        split = self.owners[at[np.arange(1), np.argmax(maxima * weight, axis=1)]] if len(self.owners) else begin
        while True:
            # An interval whose bound equals the last score can still hold a smaller id.
            least, last = (score[-1], ids[-1]) if len(score) >= top else (0, None)
            alive = bound > least
            if last is not None:
                alive |= (bound == least) & (self.ids[begin] < last)
            low, high, begin, bound, split = low[alive], high[alive], begin[alive], bound[alive], split[alive]
            if not len(bound):
                return score, ids
            first = np.argsort(-bound, kind="stable")[:STEP]
            doc = split[first]
            middle = np.searchsorted(self.places, base[None, :] + doc[:, None])
            held = (middle < high[first]) & (self.owners[np.minimum(middle, len(self.owners) - 1)] == doc[:, None])
            exact = np.where(held, self.impact[np.minimum(middle, len(self.impact) - 1)], 0) @ weight
            score, ids = np.concatenate([score, exact[exact > 0]]), np.concatenate([ids, self.ids[doc[exact > 0]]])
            order = np.lexsort((ids, -score))[:top]
            score, ids = score[order], ids[order]
            new_low = np.concatenate([low[first], middle + held])
            new_high = np.concatenate([middle, high[first]])
            new_begin = np.concatenate([begin[first], np.minimum(doc + 1, self.size - 1)])
            maxima, at = self.range_maximum(new_low, new_high)
            rest = np.ones(len(bound), bool)
            rest[first] = False
            chosen = at[np.arange(len(at)), np.argmax(maxima * weight, axis=1)]
            low, high = np.concatenate([low[rest], new_low]), np.concatenate([high[rest], new_high])
            begin, bound = np.concatenate([begin[rest], new_begin]), np.concatenate([bound[rest], maxima @ weight])
            split = np.concatenate([split[rest], self.owners[chosen]])


def _shards(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, size: int) -> Iterator[Shard]:
    held: list[pa.RecordBatch] = []

    def shard() -> Shard:
        table = pa.Table.from_batches(held).combine_chunks()
        rank = np.argsort(table.column("id").to_numpy(), kind="stable")
        table = table.take(pa.array(rank))
        lists = table.column("terms").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        owners = np.repeat(np.arange(len(lengths)), lengths)
        tf = table.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
        n = table.column("n").to_numpy()[owners]
        return Shard(table.column("id").to_numpy(), lists.flatten().to_numpy(), owners, impacts(tf, n, n_docs, n_terms))

    postings = 0
    for batch in batches:
        lengths = np.cumsum(batch.column("n_postings").to_numpy())
        begin = 0
        while begin < len(batch):
            done = lengths[begin - 1] if begin else 0
            end = min(len(batch), int(np.searchsorted(lengths, done + size - postings)) + 1)
            held.append(batch.slice(begin, end - begin))
            postings += int(lengths[end - 1] - done)
            begin = end
            if postings >= size:
                yield shard()
                held, postings = [], 0
    if held:
        yield shard()


def _search(queries, n_docs: int, n_terms: int, top: int, size: int) -> Callable:
    """The ``top`` best documents of a task's shards, per item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        best = {item: (empty, empty) for item, _, _ in queries.value}
        for shard in _shards(batches, n_docs, n_terms, size):
            for item, terms, weight in queries.value:
                best[item] = shard.search(terms, weight, top, *best[item])
        for item, (score, ids) in best.items():
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), item)), pa.array(ids), pa.array(score)], ["item", "id", "score"]
                )

    return run


def _weighted(items: list, weight_of: dict[int, int], number: dict[bytes, int]) -> list:
    """(item, terms, weights with repeats) of the items that hold a term of some document."""
    out = []
    for row in items:
        found: dict[int, int] = {}
        for term in terms_of(row.text):
            k = number[term]
            if weight_of.get(k, 0) > 0:
                found[k] = found.get(k, 0) + weight_of[k]
        if found:
            out.append((row.position, np.array(list(found), np.int64), np.array(list(found.values()), np.int64)))
    return out


def search(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    item_text: str = "text",
    item_column: str = "item_id",
    top: int = TOP,
    items_per_block: int = ITEMS_PER_BLOCK,
    shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """The ``top`` documents of each item: item id, rank (from 1), document id, score.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z in
    lower case. Scores are whole numbers: per term of the item, repeats included,
    its weight floor(1000 ln((2N + 2) / (2 df + 1))) times its impact in the
    document. Only scores above 0 count; equal scores go by ascending id.

    All documents are indexed and counted. Items are answered in blocks of
    ``items_per_block``, one pass over the documents each; tasks hold the terms
    and weights of one block. A task hands on its ``top`` documents per item, so
    the shuffle holds at most tasks x items x ``top`` rows.

    Null and blank texts have no term: such documents are never found, such items
    find nothing. Rows that repeat an id, in either table, are documents and
    items of their own. A document with a null id counts in N, L and df and is
    never returned. Ids of documents are 64-bit integers. Empty tables give an
    empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = items.schema[item_column].dataType.simpleString()
    asked = with_positions(
        written(items.select(F.col(item_column).alias("item"), F.col(item_text).cast("string").alias("text")), "items"), ["item", "text"]
    )
    asked = written(asked, "numbered-items")
    last = asked.agg(F.max("position")).first()[0]
    found = spark.createDataFrame([], f"{item_column} {kind}, rank int, {id_column} bigint, score bigint")
    for start in range(0, -1 if last is None else last + 1, items_per_block):
        block = asked.where(F.col("position").between(start, start + items_per_block - 1))
        rows = block.select("position", "text").collect()
        vocabulary = sorted({term for row in rows for term in terms_of(row.text)})
        source = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
        shared = spark.sparkContext.broadcast(vocabulary)
        index = written(
            source.mapInArrow(_index(shared), "id bigint, n bigint, terms array<int>, tf array<int>").withColumn(
                "n_postings", F.size("terms").cast("bigint")
            ),
            "postings",
        )
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs or not vocabulary:
            continue
        # At most one row per term of the block reaches the driver.
        weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
        frequencies = index.select("terms").mapInArrow(_document_frequencies, "term int, df bigint").groupBy("term")
        weights = dict(frequencies.agg(F.sum("df").alias("df")).select("term", weight.cast("bigint")).collect())
        number = {term: k for k, term in enumerate(vocabulary)}
        queries = spark.sparkContext.broadcast(_weighted(rows, weights, number))
        best = index.where("id IS NOT NULL AND n_postings > 0").mapInArrow(
            _search(queries, n_docs, n_terms, top, shard_postings), "item bigint, id bigint, score bigint"
        )
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
        ranked = best.withColumn("rank", rank).where(F.col("rank") <= top)
        names = block.select("position", F.col("item").alias("name"))
        found = found.unionByName(
            written(
                ranked.join(names, ranked["item"] == names["position"]).select(
                    F.col("name").alias(item_column), "rank", F.col("id").alias(id_column), "score"
                ),
                "ranked",
            )
        )
    return found
