"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item is a set of short shingles. Shingles are ordered by how
rare they are in all documents. A document that contains a whole window holds
also the rarest shingle of it, so this one token is a prefix that must match; the
places at which documents hold a prefix token are joined with the windows that it
stands for. Length and position then bound where the window would lie, and the
words found there are compared with the window's own, one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import hashed_terms, portions, shingles, written

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 10, 4
#: A filter of hashes is this many bits (2 MiB), whatever it holds; what passes it wrongly finds no partner in the join.
FILTER_BITS = 24


def hash_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits of the leading ``FILTER_BITS`` of the hashes, as 64-bit words; at most 2^18 rows reach the driver."""
    lead = F.shiftrightunsigned(column, 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({column}, {64 - FILTER_BITS}) & 63 AS INT))")
    rows = hashes.groupBy(F.shiftright(lead, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for row in rows:
        table[row.word] = np.uint64(row.bits & 0xFFFFFFFFFFFFFFFF)
    return table


def _passing(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    lead = hashes >> np.uint64(64 - FILTER_BITS)
    return (table[lead >> np.uint64(6)] >> (lead & np.uint64(63))) & np.uint64(1) != 0


def _windows(window: int, shingle: int) -> Callable:
    """(item, words, n, tokens): the windows of each item and the hashes of their shingles, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 1 << 18):
            names, texts, sizes, tokens = [], [], [], []
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data, begins, ends, hashes, _ = hashed_terms([text])
                count = len(hashes)
                if not count:
                    continue
                width, found = min(window, count), shingles(hashes, shingle).view(np.int64)
                per_window = width - min(shingle, count) + 1
                for k in range(count - width + 1):
                    names.append(name)
                    texts.append(_plain(data, begins[k], ends[k + width - 1]))
                    sizes.append(width)
                    tokens.append(found[k : k + per_window])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, batch.column("item").type), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))],
                ["item", "words", "n", "tokens"],
            )

    return run


def _plain(data: bytes, begin: int, end: int) -> str:
    """The terms between two places, with one space between them."""
    return b" ".join(data[begin:end].split()).decode("utf-8", "surrogatepass")


def _hits(hashes: np.ndarray, counts: np.ndarray, widths: list[int], table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places in the terms of all texts, hashes) of the shingles that pass the filter and lie inside one text."""
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))  # terms of the text from here on
    for width in widths:
        if len(hashes) >= width:
            found = shingles(hashes, width)
            places = np.flatnonzero(_passing(found, table) & (left[: len(found)] >= width))
            yield width, places, found[places]


def _counted(shared, widths: list[int]) -> Callable:
    """Occurrences of the shingles that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            _, _, _, hashes, counts = hashed_terms(batch.column("text").to_pylist())
            for _, _, found in _hits(hashes, counts, widths, shared.value):
                tokens, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], ["token", "n"])

    return run


_FOUND = "row bigint, n_words bigint, found array<struct<token: bigint, place: bigint, lead: bigint, around: string>>"


def _located(shared, widths: list[int], window: int) -> Callable:
    """Per document: its number of words, and each place of a prefix token with the words that a window there could take.

    ``lead`` of the words ``around`` come before the place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            data, begins, ends, hashes, counts = hashed_terms(batch.column("text").to_pylist())
            upto = np.cumsum(counts)
            found: list[list] = [[] for _ in counts]
            for width, places, tokens in _hits(hashes, counts, widths, shared.value):
                owners = np.searchsorted(upto, places, side="right")
                first, last = upto[owners] - counts[owners], upto[owners] - 1  # terms of the text
                lead = np.minimum(places - first, window - width)
                left, right = begins[places - lead], ends[np.minimum(places + window - 1, last)]
                rows = zip(owners, tokens.view(np.int64), places - first, lead, left, right, strict=True)
                for k, token, place, before, a, b in rows:
                    found[k].append({"token": int(token), "place": int(place), "lead": int(before), "around": _plain(data, a, b)})
            kind = pa.list_(pa.struct([("token", pa.int64()), ("place", pa.int64()), ("lead", pa.int64()), ("around", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(counts), pa.array(found, kind), batch.column("id")],
                ["row", "n_words", "found", "id"],
            )

    return run


def contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    item_text: str = "text",
    item_column: str = "item_id",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """One row per input row: id, n_words, spans, items.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in
    lower case. A window is ``window`` consecutive words of an item; an item of
    fewer words is one window. ``spans`` are the parts of the document covered by
    occurrences of windows, as sorted (begin, end) in words that neither touch nor
    overlap; ``items`` are the ids, as sorted distinct strings, of the items with
    a window that occurs (a null id reads as the empty string).

    Rarity is counted over all documents. Tasks hold a filter of 2 MiB and one
    portion of texts; windows meet documents in equi-joins, and the documents
    that share a set of windows look up its items once.

    Null and blank texts have no words: such documents have no span, such items
    no window. Repeated rows are documents of their own; items that repeat an id
    count once. A null id of a document stays null. Empty tables give empty
    results, or documents without spans. Other columns are not read.
    """
    if not 0 < shingle <= window:
        raise ValueError("need 0 < shingle <= window")
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")
    )
    named = items.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text")
    )
    made = written(named.mapInArrow(_windows(window, shingle), "item string, words string, n int, tokens array<bigint>"), "windows")
    windows = made.groupBy("words").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    tokens = windows.select("words", "n", F.posexplode("tokens").alias("offset", "token"))
    # Shingles of an item that has fewer words are shorter; at most ``shingle`` widths.
    widths = sorted({min(r.n, shingle) for r in made.select("n").distinct().collect()})

    every = spark.sparkContext.broadcast(hash_filter(tokens, "token"))
    counts = source.select("text").mapInArrow(_counted(every, widths), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("df"))
    # A window with a shingle that no document has cannot occur, and leaves here.
    ranked = tokens.join(written(counts, "rarity"), "token", "left").groupBy("words", "n").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "offset")).alias("prefix")
    )
    prefixes = written(ranked.where("prefix.df > 0").select("words", "n", "prefix.token", "prefix.offset"), "prefixes")

    prefix_filter = spark.sparkContext.broadcast(hash_filter(prefixes, "token"))
    located = written(source.mapInArrow(_located(prefix_filter, widths, window), f"{_FOUND}, id {kind}"), "places")
    places = located.select("row", "n_words", F.inline("found"))
    begin = F.col("place") - F.col("offset")
    # Spark may read the words before it tests the bounds, and a slice must start at 1 or later.
    first = F.greatest(F.col("lead") - F.col("offset") + 1, F.lit(1))
    candidates = (
        places.join(prefixes.select("token", "offset", "n").distinct(), "token")
        .where((begin >= 0) & (begin + F.col("n") <= F.col("n_words")) & (F.col("offset") <= F.col("lead")))
        .select(
            "row", begin.alias("begin"), "n",
            F.array_join(F.slice(F.split("around", " "), first, F.col("n")), " ").alias("words"),
        )
    )
    numbers = written(prefixes.select("words", F.monotonically_increasing_id().alias("window")), "window-numbers")
    hits = candidates.join(numbers, "words").select("row", "begin", (F.col("begin") + F.col("n")).alias("end"), "window")
    by_begin = Window.partitionBy("row").orderBy("begin", "end")
    reached = F.max("end").over(by_begin.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("begin") > reached), 1).otherwise(0)
    islands = hits.withColumn("opens", opens).withColumn("island", F.sum("opens").over(by_begin.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("row", "island").agg(
        F.struct(F.min("begin").alias("begin"), F.max("end").alias("end")).alias("span"), F.collect_set("window").alias("of_span")
    )
    by_document = written(
        spans.groupBy("row").agg(
            F.array_sort(F.collect_list("span")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("of_span")))).alias("windows"),
        ),
        "hit-documents",
    )
    sets = by_document.select("windows").distinct().withColumn("window", F.explode("windows"))
    owners = made.join(numbers, "words").select("window", "item").distinct()
    owned = sets.join(owners, "window").groupBy("windows").agg(F.array_sort(F.collect_set("item")).alias("items"))
    marked = by_document.join(owned, "windows").select("row", "spans", "items")
    return (
        located.select("row", "id", "n_words").join(marked, "row", "left")
        .select(
            F.col("id").alias(id_column), "n_words",
            F.coalesce("spans", F.array().cast("array<struct<begin: bigint, end: bigint>>")).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
